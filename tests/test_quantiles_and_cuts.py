"""Exact medians without a sort of all rows, and samples by a cut of the hash order, with the members of a full sort."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.parsing import json_body
from tidemark.operators import allocation as L
from tidemark.operators import evaluation as E
from tidemark.operators import quantiles as Q


@pytest.mark.parametrize("few", [10_000, 3])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = random.Random(1)
    cases = [[1.0], [1.0, 2.0], [5.0] * 40 + [1.0], [rng.lognormvariate(0, 9) for _ in range(501)], [rng.gauss(0, 1) for _ in range(500)], [-1e308, 1e308, 0.0, 1.0, 2.0], [math.inf, 1.0, 2.0], [0.1] * 300 + [rng.random() for _ in range(99)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
        if math.isinf(max(values)):
            values, df = [v for v in values if not math.isinf(v)], df.where("x < 1e300")
        assert Q.median(df, "x") == statistics.median(values)
    assert Q.median(spark.createDataFrame([], "x double"), "x") is None


def test_timing_has_no_percentile(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (2.0,), (None,), (1.0,)], "s double")
    got = E.timing(df, "s")
    assert got.first().asDict() == {"mean_time": round(3.5 / 3, 6), "median_time": 1.0, "n": 3}
    plan = got._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
    assert E.timing(df.limit(0), "s").first()["median_time"] is None


@pytest.mark.parametrize("topics", [100_000, 0])
def test_samples_have_the_members_of_a_full_sort(spark, monkeypatch, topics):
    monkeypatch.setattr(L, "BROADCAST_TOPICS", topics)
    rows = [(k, "abcd"[min(3, k % 17 // 4)], "x") for k in range(3000)] + [(k, "e", "y") for k in range(5)] + [(9000, None, "z"), (7, "a", "again")]
    quota = [("a", 100), ("b", 5000), ("c", 1), ("d", 0), ("e", 5), ("none", 3)]
    got = L.stratified_sample(spark.createDataFrame(rows, "k long, topic string, _rest string").repartition(3), spark.createDataFrame(quota, "topic string, allocated int"), "k")
    assert got.columns == ["k", "topic", "_rest"]
    import hashlib

    want = []
    for topic, n in quota:
        own = sorted((hashlib.md5(f"42|{k}".encode()).hexdigest(), k) for k, t, _ in rows if t == topic)
        want += [(k, topic) for _, k in own[:n]]
    assert sorted((r["k"], r["topic"]) for r in got.collect()) == sorted(want)
    some = L.test_sample(spark.range(500).withColumnRenamed("id", "k"), "k", 20)
    assert {r["k"] for r in some.collect()} == {k for _, k in sorted((hashlib.md5(f"42|{k}".encode()).hexdigest(), k) for k in range(500))[:20]}
    assert L.test_sample(spark.range(5).withColumnRenamed("id", "k"), "k", 20).count() == 5


def test_empty_tags_decide(spark):
    cases = [('<json></json> {"a":1}', ""), ("<json> x </json>", "x"), ('```json\n``` {"a":1}', ""), ('say {"a":1} ok', '{"a":1}'), ("none", ""), ('```py\n{"b":2}\n```', '{"b":2}')]
    rows = spark.createDataFrame(cases, "t string, want string")
    assert [r[0] for r in rows.select(json_body(F.col("t"))).collect()] == [w for _, w in cases]
