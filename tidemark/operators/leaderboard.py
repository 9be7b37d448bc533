"""Submissions, their scores and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators.order import placed

METRICS = ("topk", "recall", "f1", "ndcg", "correctness", "faithfulness")


def _invalid() -> Column:
    m = lambda name: F.col(name).try_cast("double")
    bad = m("topk").isNull() | (m("topk") <= 0)
    for name in METRICS[1:]:
        bad = bad | m(name).isNull() | (m(name) < 0) | (m(name) > 1)
    return F.coalesce(bad, F.lit(True))


def validate(games: DataFrame, required: list[str]) -> DataFrame:
    """(system_name, n_games, n_invalid, missing, is_valid) of long rows (system_name, game, six metrics as text).

    Every game's metrics are checked, extra ones too: topk above 0, the others from 0 to 1, all of them numbers;
    all required games must be there.
    """
    have = [F.count_if(F.col("game") == g) for g in required]
    missing = sum((F.when(h == 0, 1).otherwise(0) for h in have), F.lit(0))
    out = games.withColumn("bad", _invalid()).groupBy("system_name").agg(F.count("*").alias("n_games"), F.count_if("bad").alias("n_invalid"), missing.cast("long").alias("missing"))
    return out.withColumn("is_valid", F.expr("n_invalid = 0 and missing = 0") & (F.trim(F.coalesce("system_name", F.lit(""))) != ""))


def average(games: DataFrame, required: list[str]) -> DataFrame:
    """(system_name, topk, five means) over the required games; topk is that of the first of them, as a whole number."""
    place = F.array_position(F.array(*(F.lit(g) for g in required)), F.col("game"))
    own = games.where(F.col("game").isin(required)).withColumn("place", place)
    return own.groupBy("system_name").agg(F.min_by(F.col("topk").cast("double"), "place").cast("int").alias("topk"), *(F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in METRICS[1:]))


def scored(averages: DataFrame) -> DataFrame:
    """With retrieval_score, generation_score and total_score."""
    r = M.retrieval_score(F.col("recall"), F.col("f1"), F.col("ndcg"))
    g = M.generation_score(F.col("correctness"), F.col("faithfulness"))
    return averages.withColumns({"retrieval_score": r, "generation_score": g, "total_score": M.total_score(r, g)})


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables (seq, system_name, total_score, ...) as one, each system once: only a strictly higher total replaces.

    The first of equal totals stays; existing rows come before new ones.
    """
    both = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("system_name").orderBy(F.desc("total_score"), "_age", "seq"))
    return both.withColumn("_r", first).where("_r = 1").drop("_r", "_age")


def ranked(board: DataFrame) -> DataFrame:
    """With ``rank`` by total, the first entered first among equals."""
    total = F.col("total_score").cast("double")
    key = F.struct(total.isNull().alias("no"), (~F.isnan(total)).alias("number"), (-total).alias("total"), F.col("seq").alias("seq"), F.col("system_name").alias("name"))
    return placed(board, key, "rank")
