"""Aggregates of retrieval and generation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators.quantiles import median

NAMES = ("recall", "precision", "f1", "ndcg")


def per_query(results: DataFrame, k_values: tuple[int, ...] = (3,), dedup: bool = True) -> DataFrame:
    """``results`` (retrieved, relevant: arrays of ids) with one row for each k and the four metrics.

    Null and empty ids don't count; the rows of a query without relevant ids have ``valid`` false and zeros. With the columns
    ``n_relevant`` and ``n_different`` (relevant ids with and without repeats, null for none) ``relevant`` is only
    those of the relevant ids that are retrieved, so that no row has a list that grows with the corpus.
    """
    cleaned = results.withColumn("retrieved", M.clean_ids(F.col("retrieved"))).withColumn("relevant", M.clean_ids(F.col("relevant")))
    r, g = F.col("retrieved"), F.col("relevant")
    counted = ("n_relevant", "n_different") if "n_relevant" in cleaned.columns else ()
    n, different = (F.coalesce(c, F.lit(0)) for c in counted) if counted else (None, None)
    each = F.array(*(F.struct(F.lit(k).alias("k"), M.recall(r, g, k, n).alias("recall"), M.precision(r, g, k).alias("precision"), M.f1(r, g, k, n).alias("f1"), M.ndcg(r, g, k, dedup, different).alias("ndcg")) for k in k_values))
    valid = F.size("relevant") > 0 if n is None else n > 0
    return cleaned.withColumn("valid", valid).withColumn("m", F.explode(each)).select(*[c for c in cleaned.columns if c not in ("retrieved", "relevant", *counted)], "valid", "m.*")


def _means(names=NAMES) -> list[Column]:
    return [F.round(F.coalesce(F.avg(F.when(F.col("valid"), F.col(n))), F.lit(0.0)), 6).alias(n) for n in names]


def overall(measured: DataFrame) -> DataFrame:
    """By k: macro means over the queries with relevant ids, total_queries, valid_queries, coverage."""
    return measured.groupBy("k").agg(*_means(), F.count("*").alias("total_queries"), F.count_if("valid").alias("valid_queries"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("coverage"))


def by_group(measured: DataFrame, *group: str) -> DataFrame:
    """By the group's columns: macro means and the number of queries with relevant ids."""
    return measured.where("valid").groupBy(*group).agg(*_means(), F.count("*").alias("n"))


def by_dimensions(measured: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, value, k, metrics, n): one grouping for each dimension, in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions))
    return by_group(measured.withColumn("d", F.explode(pairs)).select("*", "d.*"), "dimension", "value", "k")


def cross_segment(measured: DataFrame) -> DataFrame:
    """By model_key: means over segments of the segments' means."""
    inner = measured.where("valid").groupBy("model_key", "segment_id").agg(*(F.avg(n).alias(n) for n in NAMES))
    return inner.groupBy("model_key").agg(*(F.round(F.avg(n), 6).alias(n) for n in NAMES), F.count("*").alias("n_segments"))


def timing(results: DataFrame, seconds: str) -> DataFrame:
    """Mean, median and count of the times above 0; the median is exact, and no task has all times."""
    some = results.where(F.col(seconds) > 0)
    return some.agg(F.round(F.avg(seconds), 6).alias("mean_time"), F.count("*").alias("n")).select("mean_time", F.round(F.lit(median(some, seconds)).cast("double"), 6).alias("median_time"), "n")


def judge_means(judged: DataFrame) -> DataFrame:
    """(game_name, correctness, faithfulness, n) for every game and, with 'all', over all rows; null scores count as 0."""
    out = judged.rollup("game_name").agg(*(F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c) for c in ("correctness", "faithfulness")), F.count("*").alias("n"), F.grouping("game_name").alias("g"))
    return out.withColumn("game_name", F.when(F.col("g") == 1, "all").otherwise(F.coalesce("game_name", F.lit("unknown")))).drop("g")


def guarded_judge(raw: Column, answer: Column, truth: Column, contexts: Column | None = None, normalize: bool = True) -> Column:
    """The judge's score, 0 where the answer or the truth is blank, or for faithfulness no context is given."""
    some = (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.trim(F.coalesce(truth, F.lit(""))) != "")
    if contexts is not None:
        some = some & (F.size(F.coalesce(contexts, F.array().cast("array<string>"))) > 0)
    return F.when(some, M.judge_score(raw, normalize)).otherwise(F.lit(0.0))


def answer_statistics(results: DataFrame, answer: str = "answer") -> DataFrame:
    """total, answered (non-blank), rate, average length of the answered."""
    some = F.trim(F.coalesce(F.col(answer), F.lit(""))) != ""
    n = F.count_if(some)
    return results.agg(F.count("*").alias("total"), n.alias("answered"), F.round(F.coalesce(F.try_divide(n, F.count("*")), F.lit(0.0)), 6).alias("rate"), F.round(F.coalesce(F.try_divide(F.sum(F.when(some, F.length(answer))), n), F.lit(0.0)), 6).alias("avg_length"))


def metric_statistics(values: DataFrame, value: str, *group: str) -> DataFrame:
    """mean, population deviation, min, max, count and total of the values of 0 and more."""
    own = values.where(F.col(value) >= 0).groupBy(*group)
    return own.agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def run_report(results: DataFrame) -> DataFrame:
    """(segment_id, n, ok, success_percent) and the mean of every metric there."""
    ok = F.count_if(F.col("error").isNull())
    return results.groupBy("segment_id").agg(F.count("*").alias("n"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 2).alias("success_percent"), *(F.round(F.avg(n), 6).alias(n) for n in NAMES if n in results.columns))


def success_rate(generated: Column, attempts: Column) -> Column:
    """generated / attempts, 0 without any attempt."""
    return F.coalesce(F.try_divide(generated, attempts), F.lit(0.0))


def with_mean_time(results: DataFrame, seconds: float) -> DataFrame:
    """``results`` with ``retrieval_time``: the seconds of the whole batch over its rows."""
    n = results.count()
    return results.withColumn("retrieval_time", F.lit(seconds / n if n else 0.0))
