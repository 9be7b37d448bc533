"""Cut lineage with Parquet tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes that go to Python at a time at most, which bounds the buffers on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_written: list[tuple[SparkSession, str]] = []
_held: dict[Hashable, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches be small ones from now on; smaller ones that are set stay. It changes no result of any query."""
    for key, most in BATCHES.items():
        now = re.fullmatch(r"(\d+)([bkm]?)b?", spark.conf.get(key).strip().lower())
        size = int(now[1]) << {"": 0, "b": 0, "k": 10, "m": 20}[now[2]] if now else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Later plans read files that survive the loss of any executor, and an iterative plan stays short. The tables are
    removed when the driver ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)
        _written.remove((df.sparkSession, df._written_to))


def until_the_end(spark: SparkSession, path: str) -> str:
    """``path``, to be removed when the driver ends."""
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held(key: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """What the tasks of one operator share in a Python worker, made by the first of them.

    A worker serves one operator after another, and idle ones stay for a while: the first task of another
    operator drops what this one holds.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def hash_bound(wanted: int, of: int) -> int:
    """The value that about ``wanted`` of ``of`` 64-bit hashes don't exceed; all of them if there aren't more.

    A filter by it comes before a sort with a limit, so that what every task hands on is the sample and not
    as many rows as the limit again.
    """
    return 2**63 - 1 if of <= wanted else int(-(2**63) + 2**64 * (wanted / of))


def release() -> None:
    """Give free memory back: a worker stays for the next tasks, of this job or another."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def widened(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with more columns; the data frame's own schema object stays as it is."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items())).fields])


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the cluster clears its checkpoint folder
            return
