"""Tables that grow by batches: a batch counts from the moment its record is there, and never by half.

Each batch is a folder of its own under ``data``. A record under ``manifest`` names the folders that it adds and those
that it replaces; records are numbered, put in place by a rename that fails if the number is taken, and read in order.
A run that stops between the two leaves a folder that no record names: readers don't see it, ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import exists

_RECORD = "version LONG, add ARRAY<STRING>, remove ARRAY<STRING>, info MAP<STRING, STRING>"


class Conflict(Exception):
    """Another writer has taken the version."""


class CommitLog:
    """The batches below ``root``. One log is one table; its parts may hold several tables of the same names each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def records(self) -> list[dict]:
        """All records in order, one for each commit since the log was last squashed."""
        if not exists(self.spark, f"{self.root}/manifest/*.json"):
            return []
        rows = self.spark.read.schema(_RECORD).json(f"{self.root}/manifest/*.json").orderBy("version").collect()
        return [{"version": r["version"], "add": r["add"] or [], "remove": r["remove"] or [], "info": r["info"] or {}} for r in rows]

    def state(self) -> tuple[int, list[str]]:
        """(version, folders that count, in the order in which they came); version 0 is an empty log."""
        version, parts = 0, []
        for r in self.records():
            version = r["version"]
            parts = [p for p in parts if p not in r["remove"]] + r["add"]
        return version, parts

    def stage(self, **tables: DataFrame) -> str:
        """Write a batch of one or more tables; it doesn't count yet. The name of its folder."""
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/data/{name}/{table}")
        return name

    def commit(self, add: list[str], remove: list[str] | None = None, after: int | None = None, **info: str) -> int:
        """Let staged folders count, and others no more, as the version after ``after`` (the latest one by default)."""
        version = (self.state()[0] if after is None else after) + 1
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{version:012d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        fs = final.getFileSystem(conf)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "add": add, "remove": remove or [], "info": info}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, never)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or fs.exists(final):
                raise Conflict(f"version {version} of {self.root} is there already") from e
            raise
        return version

    def append(self, df: DataFrame, **info: str) -> int:
        """Write and commit a batch of the table ``rows``."""
        return self.commit([self.stage(rows=df)], **info)

    def read(self, schema: str | None = None, table: str = "rows") -> DataFrame:
        """The committed batches of a table, as they are now; with ``schema``, an empty log is an empty table."""
        parts = self.state()[1]
        if not parts:
            if schema is None:
                raise ValueError(f"nothing is committed in {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/data/{p}/{table}" for p in parts))

    def compact(self) -> int:
        """All batches of ``rows`` as one; readers of the version before keep theirs until ``vacuum``."""
        version, parts = self.state()
        return self.commit([self.stage(rows=self.read())], parts, after=version) if len(parts) > 1 else version

    def vacuum(self) -> list[str]:
        """Remove the folders that don't count: replaced ones and those of runs that stopped. No run may be writing."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [str(x.getPath().getName()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = sorted(set(there) - set(self.state()[1]))
        for name in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{name}"), True)
        return gone


def left_to_do(rows: DataFrame, log: CommitLog, key: str) -> DataFrame:
    """The rows whose ``key`` no committed batch has."""
    if not log.state()[1]:
        return rows
    return rows.join(log.read().select(key).distinct(), key, "left_anti")


def progress(log: CommitLog, key: str) -> DataFrame:
    """One row (version, batches, generated_count, done): the last commit, the batches, their rows, and distinct keys."""
    version, parts = log.state()
    if not parts:
        return log.spark.createDataFrame([(0, 0, 0, 0)], "version long, batches long, generated_count long, done long")
    own = log.read().agg(F.count("*").alias("generated_count"), F.count_distinct(key).alias("done"))
    return own.select(F.lit(version).cast("long").alias("version"), F.lit(len(parts)).cast("long").alias("batches"), "generated_count", "done")
