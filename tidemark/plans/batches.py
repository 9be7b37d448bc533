"""Work by batches that survives a stop: what a batch has made and which rows it took count from one commit on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.allocation import first_of_each, seeded_order
from tidemark.sources.commits import CommitLog
from tidemark.sources.scratch import kept


def left_over(rows: DataFrame, log: CommitLog, key: str) -> DataFrame:
    """The rows that no committed batch has taken, whether it made anything of them or not."""
    return rows.join(log.read(table="done").select(key).distinct(), key, "left_anti") if log.state()[1] else rows


def made(log: CommitLog) -> int:
    """Rows of all committed batches."""
    return log.read().count() if log.state()[1] else 0


def run_batches(rows: DataFrame, root: str, make: Callable[[DataFrame], DataFrame], key: str, size: int = 1000, target: int | None = None, most: int | None = None) -> CommitLog:
    """``make`` of batches of ``size`` of ``rows``, each committed to the log at ``root``, until none is left.

    Rows are taken in the order of a hash of ``key``, those of committed batches never again: a run that stops anywhere goes
    on with the batch it was in, and a second run of finished work does nothing. With ``target`` it ends with the
    batch that makes as many rows in all runs, with ``most`` after so many batches of its own.
    """
    log, done = CommitLog(rows.sparkSession, root), 0
    everything = rows.sparkSession.createDataFrame([(0, size)], "_all int, allocated long")
    while (most is None or done < most) and (target is None or made(log) < target):
        left = left_over(rows, log, key).withColumn("_all", F.lit(0))
        own = kept(first_of_each(left, everything, "_all", seeded_order(F.col(key)), key).drop("_all"), "batch")
        if own.isEmpty():
            break
        log.commit([log.stage(rows=make(own), done=own.select(key))])
        done += 1
    return log
