"""Dates and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, table
from tidemark.operators import temporal as T

# Six segments with a gap of two days.
SEGMENTS = [(0, 1, "2024-01-01", "2024-01-06"), (1, 2, "2024-01-06", "2024-01-11"), (2, 3, "2024-01-11", "2024-01-16"), (3, 4, "2024-01-18", "2024-01-23"), (4, 5, "2024-01-23", "2024-01-28"), (5, 6, "2024-01-28", "2024-02-02")]
_SQL_SEGMENTS = "(VALUES " + ", ".join(f"({p}, {i}, DATE '{s}', DATE '{e}')" for p, i, s, e in SEGMENTS) + ") AS s(position, segment_id, s, e)"
_SQL_NAME = "CASE WHEN doc_id % 7 = 0 THEN 'doc_' || doc_id WHEN doc_id % 11 = 0 THEN '2024-13-45_doc_' || doc_id ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER), '%Y-%m-%d') || '_doc_' || doc_id END"
_SQL_DATE = f"TRY_CAST(NULLIF(regexp_extract({_SQL_NAME}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE)"


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "position int, segment_id int, start_date string, end_date string")


def _named(spark, sf):
    dated = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")), "yyyy-MM-dd")
    tail = F.concat(F.lit("_doc_"), F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("2024-13-45"), tail)).otherwise(F.concat(dated, tail))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"))



@query(f"WITH d AS (SELECT doc_id, {_SQL_DATE} AS day FROM documents), x AS (SELECT d.doc_id, min(segment_id) AS g FROM d JOIN {_SQL_SEGMENTS} ON s <= day AND day < e GROUP BY d.doc_id) SELECT d.doc_id, CAST(coalesce(g, -1) AS INTEGER) AS segment_id FROM d LEFT JOIN x ON d.doc_id = x.doc_id")
def seg_assign_docs(spark, sf):
    return T.assign_segments(_named(spark, sf), T.name_date(F.col("name")).try_cast("date"), segments(spark)).select("doc_id", "segment_id")


@query(f"WITH d AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), x AS (SELECT d.event_id, min(segment_id) AS g FROM d JOIN {_SQL_SEGMENTS} ON s <= day AND day < e GROUP BY d.event_id) SELECT CAST(coalesce(g, -1) AS INTEGER) AS segment_id, count(*) AS n FROM d LEFT JOIN x ON d.event_id = x.event_id GROUP BY 1")
def seg_assign_events(spark, sf):
    return T.counts_by_segment(T.assign_segments(table(spark, sf, "events"), F.col("ts"), segments(spark)))


@query(f"SELECT doc_id, strftime({_SQL_DATE}, '%Y-%m-%d') AS extracted_date, CAST(year({_SQL_DATE}) AS INTEGER) AS extracted_year, CAST(month({_SQL_DATE}) AS INTEGER) AS extracted_month, CAST(day({_SQL_DATE}) AS INTEGER) AS extracted_day, CASE WHEN {_SQL_DATE} IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN 'title' ELSE 'filename' END AS extraction_source, CASE WHEN {_SQL_DATE} IS NOT NULL THEN 'YYYY-MM-DD' END AS date_format FROM documents")
def doc_time_metadata(spark, sf):
    rows = _named(spark, sf).withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.col("name")).otherwise("untitled")).withColumn("file_path", F.concat(F.lit("/in/2023-01-01/"), "name", F.lit(".txt")))
    return T.with_time_metadata(rows).select("doc_id", "extracted_date", "extracted_year", "extracted_month", "extracted_day", "extraction_source", "date_format")


@query("SELECT o_custkey, strftime(max(TRY_CAST(x AS DATE)), '%Y-%m-%d') AS latest FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'null' WHEN o_orderkey % 5 = 1 THEN '2099-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS x FROM orders) GROUP BY o_custkey")
def latest_doc_date(spark, sf):
    x = F.when(F.col("o_orderkey") % 5 == 0, "null").when(F.col("o_orderkey") % 5 == 1, "2099-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(T.latest_date(F.array(x))).alias("latest"))
    return rows
