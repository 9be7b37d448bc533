"""Replies of models, kept: a prompt is asked once of a provider and version, whatever runs need it and however they end.

The ledger is a table that grows by committed batches. A run looks up which of its prompts no batch has answered, asks
each different one once, in rounds of bounded size, and commits each round: after a stop, the rounds before it count. A
task that is lost with its executor is repeated, and no other one. Prompts that fail are kept with their error and are
asked again by the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.providers import WAIT, Provider, asked, in_order
from tidemark.sources.commits import CommitLog
from tidemark.sources.scratch import kept

#: Different prompts that are asked and committed at a time.
ROUND = 100_000


def _known(log: CommitLog, name: str, version: str, kind: str) -> DataFrame:
    """(mark, reply, error) of this provider and version; of a prompt that failed before it was answered, the answer."""
    rows = log.read(f"provider string, version string, mark string, reply {kind}, error string, at long").where((F.col("provider") == name) & (F.col("version") == version))
    best = rows.groupBy("mark").agg(F.min_by(F.struct("reply", "error"), F.struct(F.col("error").isNotNull(), -F.col("at"))).alias("r"))
    return best.select("mark", "r.reply", "r.error")


def replies(
    df: DataFrame, prompt: str, out: str, kind: str, provider: Provider, root: str, name: str, version: str = "1", fallback=None, batch: int = 100, tries: int = 3, wait: float = WAIT, in_flight: int = 4,
) -> DataFrame:
    """``df`` with ``out``, the reply to ``prompt``, and ``{out}_error``, why there is none, through the ledger at ``root``.

    ``name`` and ``version`` say whose replies they are: another version asks anew. A null prompt is an empty one. A
    prompt that failed has ``fallback``. Each task has ``in_flight`` batches under way; see ``providers.asked`` for
    how batches are tried. Existing columns of the names of both are replaced.
    """
    log = CommitLog(df.sparkSession, root)
    df = df.drop(out, f"{out}_error")
    marked = df.withColumn("_mark", F.sha2(F.coalesce(prompt, F.lit("")), 256))
    wanted = marked.groupBy("_mark").agg(F.first(F.coalesce(prompt, F.lit(""))).alias("prompt"))
    answered = _known(log, name, version, kind).where("error is null").select(F.col("mark").alias("_mark"))
    unseen = kept(wanted.join(answered, "_mark", "left_anti"), "unseen")
    rounds = -(-unseen.count() // ROUND)

    def ask(own: pd.DataFrame) -> pd.DataFrame:
        found = asked(provider, own["prompt"].tolist(), tries, wait)
        return pd.DataFrame({"mark": own["_mark"].tolist(), "reply": [r for r, _ in found], "error": [e for _, e in found]}, dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (frame.iloc[lo : lo + batch] for frame in frames for lo in range(0, len(frame), batch))
        yield from in_order(ask, parts, in_flight)

    for k in range(rounds):
        own = unseen if rounds == 1 else unseen.where(F.pmod(F.xxhash64("_mark"), F.lit(rounds)) == k)
        at = log.state()[0] + 1
        new = own.mapInPandas(run, f"mark string, reply {kind}, error string")
        log.append(new.select(F.lit(name).alias("provider"), F.lit(version).alias("version"), "mark", "reply", "error", F.lit(at).cast("long").alias("at")), provider=name, version=version)
    known = _known(log, name, version, kind).select(F.col("mark").alias("_mark"), F.col("reply").alias(out), F.col("error").alias(f"{out}_error"))
    found = marked.join(known, "_mark", "left").drop("_mark")
    if fallback is None:
        return found
    return found.withColumn(out, F.when(F.col(f"{out}_error").isNotNull(), F.lit(fallback).cast(kind)).otherwise(F.col(out)))
