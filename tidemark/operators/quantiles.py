"""Exact quantiles of a column of any length: the range that holds the value is narrowed until it can be looked at."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that are looked at at the end, and parts that a range is cut into in each round.
FEW, PARTS = 10_000, 2048


def kth(values: DataFrame, place: int) -> float:
    """The value at ``place`` (from 0) of the column ``x`` (double, without null and NaN) in ascending order.

    Each round counts the rows of a range by its parts, in one aggregation with a row a part, and goes on with the part
    that has the place; a range of few different values ends it. Nothing is sorted but these.
    """
    low, high, before = -math.inf, math.inf, 0
    while True:
        own = values.where((F.col("x") >= low) & (F.col("x") <= high))
        span = own.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.approx_count_distinct("x").alias("n")).first()
        low, high = span["low"], span["high"]
        if low == high:
            return low
        if span["n"] <= FEW // 2:
            seen = before
            for r in own.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect():
                seen += r["n"]
                if seen > place:
                    return r["x"]
        # halves first, so that ranges beyond the largest double don't overflow
        part = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1))
        seen = before
        for r in own.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("part").collect():
            if seen + r["n"] > place:
                low, high, before = r["low"], r["high"], seen
                break
            seen += r["n"]


def median(df: DataFrame, column: str) -> float | None:
    """The median as SQL has it: the mean of the two middle values of an even number; None without a value. Nulls and NaN don't count."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.count()
    if not n:
        return None
    low = kth(values, (n - 1) // 2)
    return low if n % 2 else (low + kth(values, n // 2)) / 2
