"""Dates of documents and their time segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMELESS = -1
#: Segments up to which the lookup is an expression over a constant array; beyond, it is a join on days.
MAX_CONSTANT_SEGMENTS = 1000


def name_date(name: Column) -> Column:
    """The date that a file name begins with, as text; null without one or with an impossible one."""
    prefix = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(prefix.try_cast("date").isNotNull(), prefix)


def with_time_metadata(df: DataFrame, title: str = "title", path: str = "file_path") -> DataFrame:
    """``df`` with extracted_date, extracted_year, _month, _day, extraction_source and date_format.

    The title is tried first, then the last part of the path; without a date all six are null.
    """
    by_title, by_path = name_date(F.col(title)), name_date(F.regexp_extract(F.col(path), r"([^/]*)$", 1))
    found = F.coalesce(by_title, by_path)
    day = found.try_cast("date")
    return df.withColumns({
        "extracted_date": found,
        "extracted_year": F.year(day),
        "extracted_month": F.month(day),
        "extracted_day": F.dayofmonth(day),
        "extraction_source": F.when(by_title.isNotNull(), "title").when(by_path.isNotNull(), "filename"),
        "date_format": F.when(found.isNotNull(), "YYYY-MM-DD"),
    })


def assign_segments(df: DataFrame, day: Column, segments: DataFrame) -> DataFrame:
    """``df`` with ``segment_id``: the first segment, in list order, with start_date <= day < end_date, else -1.

    ``segments`` (position, segment_id, start_date, end_date) is configuration. A short list becomes a constant
    that each row is held against, without a shuffle; a long one is exploded to days and joined on the day.
    Null days are timeless.
    """
    day = day.cast("date")
    n = segments.count()
    if n == 0:
        return df.withColumn("segment_id", F.lit(TIMELESS))
    if n <= MAX_CONSTANT_SEGMENTS:
        rows = segments.orderBy("position").select("segment_id", F.col("start_date").cast("date").alias("s"), F.col("end_date").cast("date").alias("e")).dropna()
        known = F.array(*(F.struct(F.lit(r["segment_id"]).alias("id"), F.lit(r["s"]).alias("s"), F.lit(r["e"]).alias("e")) for r in rows.collect()))  # MAX_CONSTANT_SEGMENTS rows
        hit = F.filter(known, lambda x: (x["s"] <= day) & (day < x["e"]))
        return df.withColumn("segment_id", F.coalesce(F.get(hit, F.lit(0))["id"], F.lit(TIMELESS)))
    days = segments.where("start_date < end_date").select("segment_id", "position", F.explode(F.expr("sequence(cast(start_date as date), date_sub(cast(end_date as date), 1))")).alias("_day"))
    first = days.groupBy("_day").agg(F.min_by("segment_id", "position").alias("_segment"))
    return df.withColumn("_day", day).join(first, "_day", "left").withColumn("segment_id", F.coalesce("_segment", F.lit(TIMELESS))).drop("_day", "_segment")


def latest_date(dates: Column) -> Column:
    """The latest date of an array of texts, as text; null, 'null' and unreadable ones don't count."""
    return F.date_format(F.array_max(F.transform(dates, lambda d: d.try_cast("date"))), "yyyy-MM-dd")


def counts_by_segment(df: DataFrame) -> DataFrame:
    return df.groupBy("segment_id").agg(F.count("*").alias("n"))
