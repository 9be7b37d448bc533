"""Retrieval and answer metrics as expressions over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_ids(ids: Column) -> Column:
    """Without null and empty ids."""
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)).cast("double")


def recall(retrieved: Column, relevant: Column, k: int, n: Column | None = None) -> Column:
    """Distinct hits over the length of the relevant list, repeats included; 0 without any relevant id.

    With ``n``, the length of the whole list, ``relevant`` needs to have only those of its ids that are retrieved.
    """
    n = F.size(relevant) if n is None else n
    return F.when(n > 0, _hits(retrieved, relevant, k) / n).otherwise(F.lit(0.0))


def precision(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct hits over what was retrieved, which may be less than k and may hold repeats."""
    n = F.size(F.slice(retrieved, 1, k))
    return F.when(n > 0, _hits(retrieved, relevant, k) / n).otherwise(F.lit(0.0))


def f1(retrieved: Column, relevant: Column, k: int, n: Column | None = None) -> Column:
    p, r = precision(retrieved, relevant, k), recall(retrieved, relevant, k, n)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _gain(place: Column) -> Column:
    return F.lit(1.0) / F.log2(place + 2.0)


def ndcg(retrieved: Column, relevant: Column, k: int, dedup: bool = True, different: Column | None = None) -> Column:
    """NDCG at k. With ``dedup`` an id counts at its first place only; without, repeats count again and it may exceed 1.

    ``different`` is how many different relevant ids there are, if ``relevant`` has only those that are retrieved.
    """
    top = F.slice(retrieved, 1, k)
    at = F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x) & ((F.array_position(top, x) == i + 1) if dedup else F.lit(True)), _gain(i)).otherwise(F.lit(0.0)))
    dcg = F.aggregate(at, F.lit(0.0), lambda s, x: s + x)
    ideal = F.least(F.lit(k), (F.size(F.array_distinct(relevant)) if different is None else different).cast("int"))
    idcg = F.aggregate(F.transform(F.slice(F.sequence(F.lit(0), F.lit(k - 1)), 1, F.greatest(ideal, F.lit(0))), _gain), F.lit(0.0), lambda s, x: s + x)
    return F.when(idcg > 0, dcg / idcg).otherwise(F.lit(0.0))


def judge_score(raw: Column, normalize: bool = True) -> Column:
    """A judge's 0, 1 or 2, anything else 0; halved with ``normalize``."""
    value = F.when(raw.try_cast("double").isin(0.0, 1.0, 2.0), raw.try_cast("double")).otherwise(F.lit(0.0))
    return value / 2 if normalize else value


def retrieval_score(recall: Column, f1: Column, ndcg: Column) -> Column:
    return (recall + f1 + ndcg) / 3


def generation_score(correctness: Column, faithfulness: Column) -> Column:
    return 0.75 * correctness + 0.25 * faithfulness


def total_score(retrieval: Column, generation: Column) -> Column:
    return 0.25 * retrieval + 0.75 * generation


def dot(a: Column, b: Column) -> Column:
    """The sum of the products of two arrays; what the shorter one lacks counts as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length, 0 where either is a zero vector, in one pass over the arrays each."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
