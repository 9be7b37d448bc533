"""Queries and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import kept, scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a row group, the least that one task of a scan reads.
ROW_GROUP = 128 << 20


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work on every word: one with fewer row groups than there are cores is dealt out to all of them.

    A small file is a single row group and would keep one core busy. Larger tables, and those of as many files as
    there are cores, are read as they lie, without a shuffle; the rows are the same in either case.
    """
    df = table(spark, sf_dir, name)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < ROW_GROUP * cores and len(df.inputFiles()) < cores else df
