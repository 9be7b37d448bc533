"""Operators on small tables, with the edges that their rules name."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocation as L
from tidemark.operators import bm25 as B
from tidemark.operators import entities as E
from tidemark.operators import evaluation as V
from tidemark.operators import leaderboard as R
from tidemark.operators import qa as Q
from tidemark.operators import temporal as T
from tidemark.operators import vector as D


def rows(df):
    return [tuple(r) for r in df.collect()]


SEGMENTS = [(0, 1, "2024-01-01", "2024-01-06"), (1, 2, "2024-01-05", "2024-01-10"), (2, 3, "2024-01-12", "2024-01-13")]


@pytest.mark.parametrize("bound", [1000, 0])
def test_segments_are_half_open_and_first_wins(spark, monkeypatch, bound):
    monkeypatch.setattr(T, "MAX_CONSTANT_SEGMENTS", bound)
    segments = spark.createDataFrame(SEGMENTS, "position int, segment_id int, start_date string, end_date string")
    days = ["2024-01-01", "2024-01-05", "2024-01-06", "2024-01-10", "2024-01-12", "2024-01-13", "2023-12-31", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = dict(rows(T.assign_segments(df, F.col("d").cast("date"), segments).select("d", "segment_id")))
    assert got == dict(zip(days, [1, 1, 2, -1, 3, -1, -1, -1]))


def test_no_segments(spark):
    none = spark.createDataFrame([], "position int, segment_id int, start_date string, end_date string")
    assert rows(T.assign_segments(spark.createDataFrame([("2024-01-01",)], "d string"), F.col("d"), none)) == [("2024-01-01", -1)]


@pytest.mark.parametrize("name,date", [("2024-02-29_x", "2024-02-29"), ("2024-13-45_x", None), ("x_2024-01-01", None), ("", None)])
def test_name_date(spark, name, date):
    assert spark.createDataFrame([(name,)], "n string").select(T.name_date(F.col("n"))).first()[0] == date


def test_time_metadata_prefers_the_title(spark):
    df = spark.createDataFrame([("2024-01-02_a", "/p/2023-01-01.txt"), ("t", "/2022-01-01/2023-05-06.txt"), ("t", "/p/x.txt")], "title string, file_path string")
    got = rows(T.with_time_metadata(df).select("extracted_date", "extracted_month", "extraction_source"))
    assert got == [("2024-01-02", 1, "title"), ("2023-05-06", 5, "filename"), (None, None, None)]


def test_latest_date(spark):
    df = spark.createDataFrame([(["2024-01-02", None, "null", "2024-30-01", "2023-01-01"],), ([],), (None,)], "d array<string>")
    assert [r[0] for r in rows(df.select(T.latest_date(F.col("d"))))] == ["2024-01-02", None, None]


def test_entities(spark):
    df = spark.createDataFrame([(1, 1, [" A", "a", "", "B"]), (2, -1, ["C"]), (3, 2, [])], "id int, segment_id int, entities array<string>")
    assert rows(E.statistics(df)) == [(3, 5, 3, 2)]
    assert sorted(rows(E.segment_entities(df))) == [(1, "A"), (1, "B"), (1, "a")]
    assert rows(df.select(E.dedup_in_order(F.col("entities"))).limit(1)) == [(["A", "a", "B"],)]


def test_entity_forms(spark):
    df = spark.createDataFrame([(["a", "b"],), (['{"text":"x"}', '{"text":""}'],), (["a", '{"text":"x"}'],)], "e array<string>")
    assert [r[0] for r in rows(df.select(E.normalize_forms(F.col("e"))))] == [["a", "b"], ["x"], []]


def test_overlap_keeps_pairs_without_entities(spark):
    qa = spark.createDataFrame([(1, ["A"]), (2, []), (3, ["B", "C"])], "qa_id int, entities array<string>")
    current = spark.createDataFrame([("C",), ("C",), ("D",)], "entity string")
    assert sorted(r[0] for r in rows(E.discard_overlapping(qa, current))) == [1, 2]


def test_mentions_ignore_case_and_word_bounds(spark):
    qa = spark.createDataFrame([(1, "the SUNshine of Oz"), (2, "none")], "qa_id int, t string")
    known = spark.createDataFrame([("Sun",), ("oz",), ("moon",), ("",)], "entity string")
    assert sorted(rows(E.mentions(qa, known, F.col("t")))) == [(1, "Sun"), (1, "oz")]


def test_inherit_targets_truncate_doubles_and_sum_up(spark):
    counts = spark.createDataFrame([("a", 29), ("b", 71)], "topic string, n long")
    assert dict((t, x) for t, _, x in rows(L.inherit_targets(counts, 100))) == {"a": 28, "b": 72}
    rng = random.Random(1)
    for _ in range(5):
        table = [(f"t{i}", rng.randrange(1, 50)) for i in range(rng.randrange(1, 8))]
        n = rng.randrange(0, 200)
        assert sum(x for _, _, x in rows(L.inherit_targets(spark.createDataFrame(table, "topic string, n long"), n))) == n


def _greedy(topics, n):
    """The allocation, topic by topic."""
    inherited = sum(t[2] for t in topics)
    order = sorted((t for t in topics if t[3] > 0), key=lambda t: (-t[1], t[0]))
    out, left = {}, n
    for topic, p, have, _ in order:
        out[topic] = min(max(0, math.floor((n + inherited) * p) - have), left)
        left -= out[topic]
    k = 0
    while left and order:
        out[order[k % len(order)][0]] += 1
        left, k = left - 1, k + 1
    return out


def test_sampler_allocation_is_the_greedy_one(spark):
    rng = random.Random(2)
    for _ in range(6):
        size = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 7))]
        topics = [(f"t{i}", s / sum(size), rng.randrange(0, 12), rng.randrange(0, 3)) for i, s in enumerate(size)]
        n = rng.randrange(0, 120)
        got = {t: a for t, _, a in rows(L.sampler_allocation(spark.createDataFrame(topics, "topic string, proportion double, inherited long, n_templates long"), n))}
        assert got == _greedy(topics, n)


def test_stratified_sample_is_capped_and_repeatable(spark):
    df = spark.range(30).select("id", F.when(F.col("id") < 25, "a").otherwise("b").alias("topic"))
    quota = spark.createDataFrame([("a", 7), ("b", 9), ("c", 3)], "topic string, allocated long")
    got = rows(L.stratified_sample(df, quota, "id").select("topic", "id"))
    assert sorted(got) == sorted(rows(L.stratified_sample(df.repartition(3), quota, "id").select("topic", "id")))
    assert [sum(t == x for t, _ in got) for x in "abc"] == [7, 5, 0]


def test_task_weights(spark):
    got = dict(rows(spark.range(4000).groupBy(L.choose_task(F.col("id"))).count()))
    assert abs(got["factual"] / 4000 - 0.7) < 0.03 and abs(got["multi_hop"] / 4000 - 0.2) < 0.03


def _bm25(docs, query, k=3):
    n, avg = len(docs), sum(len(d) for d in docs.values()) / len(docs)
    score = {}
    for i, d in docs.items():
        s = 0.0
        for t in query:
            df = sum(t in x for x in docs.values())
            if t in d:
                tf = d.count(t)
                s += math.log(n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        score[i] = round(s, 4)
    return sorted(score, key=lambda i: (-score[i], -i))[:k], score


def test_bm25_with_repeats_ties_and_padding(spark):
    texts = {1: "aa bb aa", 2: "bb cc", 3: "aa bb dd dd", 4: "aa bb", 5: "ee ff"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    queries = {1: "aa aa dd", 2: "zz", 3: "cc", 4: ""}
    got = rows(B.retrieve(docs, spark.createDataFrame(list(queries.items()), "query_id long, text string"), 3, padded=True).orderBy("query_id", "rank").select("query_id", "doc_id", "score"))
    split = {i: t.split() for i, t in texts.items()}
    for q in (1, 2, 3):
        ids, score = _bm25(split, queries[q].split())
        assert [(d, s) for a, d, s in got if a == q] == [(i, pytest.approx(score[i])) for i in ids]
    assert not [g for g in got if g[0] == 4]


def test_bm25_scopes_have_their_own_statistics(spark):
    docs = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc dd", "x"), (3, "aa aa", "y")], "doc_id long, text string, g string")
    asked = spark.createDataFrame([(1, "aa", "x"), (2, "aa", "y"), (3, "aa", "z")], "query_id long, text string, g string")
    assert sorted(rows(B.retrieve(docs, asked, 3, scope="g").select("query_id", "doc_id", "score"))) == [(1, 1, round(math.log(2), 4)), (2, 3, 0.0)]


def test_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    near = D.similarities(q, v)
    assert rows(D.top_k(near, 2).where("query_id = 7").orderBy("rank").select("vec_id", "score")) == [(1, 1.0), (4, 1.0)]
    assert dict((a, b) for a, b, _ in rows(D.best_match(near))) == {7: 1, 8: None}
    monkeypatch.setattr(D, "QUERY_BLOCK", 1)
    assert sorted(rows(D.similarities(q, v))) == sorted(rows(near))


def test_personas(spark):
    df = spark.createDataFrame([(1, "a | b|"), (2, "b"), (3, "")], "persona_id long, source_topic string")
    assert sorted(rows(D.personas_by_topic(df))) == [("a", 1, 1), ("b", 2, 1)]
    assert spark.range(1).select(D.persona_text(F.lit("x"), F.lit(" "), F.lit("y"))).first()[0] == "description: x topic: y"


def test_metric_tables(spark):
    df = spark.createDataFrame([("g", 1, ["a", "", None, "b"], ["a"]), ("g", 2, None, ["b"]), ("h", 1, ["a"], [])], "game_name string, segment_id int, retrieved array<string>, relevant array<string>")
    m = V.per_query(df, (1, 3))
    o = {r["k"]: r for r in V.overall(m).collect()}
    assert (o[3]["total_queries"], o[3]["valid_queries"], o[3]["recall"]) == (3, 2, 0.5)
    assert rows(V.by_group(m, "game_name", "k").where("k = 1").select("game_name", "n")) == [("g", 2)]
    assert len(rows(V.by_dimensions(m, ("game_name", "segment_id")))) == 6


def test_generation_tables(spark):
    df = spark.createDataFrame([("g", 1.0, None), ("g", 0.0, 1.0), (None, 0.5, 0.5)], "game_name string, correctness double, faithfulness double")
    assert sorted((r["game_name"], r["correctness"], r["n"]) for r in V.judge_means(df).collect()) == [("all", 0.5, 3), ("g", 0.5, 2), ("unknown", 0.5, 1)]
    empty = spark.createDataFrame([], "answer string")
    assert rows(V.answer_statistics(empty)) == [(0, 0, 0.0, 0.0)]
    assert rows(V.run_report(spark.createDataFrame([(1, None, 0.5), (1, "x", 0.1)], "segment_id int, error string, recall double"))) == [(1, 2, 1, 50.0, 0.3)]


def test_guards(spark):
    df = spark.createDataFrame([("a", "t", ["c"]), ("", "t", ["c"]), ("a", "t", [])], "a string, t string, c array<string>")
    assert [r[0] for r in rows(df.select(V.guarded_judge(F.lit("2"), F.col("a"), F.col("t"), F.col("c"))))] == [1.0, 0.0, 0.0]


GOOD = {"topk": "3", "recall": "0.5", "f1": "0.5", "ndcg": "0.5", "correctness": "0.5", "faithfulness": "1"}


def _games(spark, *changes):
    out = []
    for name, games in changes:
        out += [(name, g, *{**GOOD, **c}.values()) for g, c in games.items()]
    return spark.createDataFrame(out, "system_name string, game string, " + ", ".join(f"{m} string" for m in GOOD))


def test_submissions(spark):
    fine = {"g1": {}, "g2": {"topk": "5"}}
    df = _games(spark, ("ok", fine), ("missing", {"g1": {}}), ("high", {**fine, "g1": {"f1": "1.2"}}), ("zero", {**fine, "g1": {"topk": "0"}}), ("text", {**fine, "g1": {"ndcg": "x"}}), ("extra", {**fine, "g9": {"recall": "-1"}}))
    got = {r["system_name"]: r["is_valid"] for r in R.validate(df, ["g1", "g2"]).collect()}
    assert got == {"ok": True, "missing": False, "high": False, "zero": False, "text": False, "extra": False}
    top = R.average(df.where("system_name = 'ok'"), ["g2", "g1"]).first()
    assert (top["topk"], top["recall"]) == (5, 0.5)


def test_only_a_higher_total_replaces(spark):
    kind = "seq long, system_name string, total_score double"
    old = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4), (3, "c", 0.9)], kind)
    new = spark.createDataFrame([(4, "a", 0.5), (5, "b", 0.6), (6, "c", 0.1), (7, "d", 0.5)], kind)
    assert [r["seq"] for r in R.ranked(R.merge(old, new)).orderBy("rank").collect()] == [3, 5, 1, 7]


def test_qa_rules(spark):
    df = spark.createDataFrame([("abcde", "0123456789"), ("abcd", "0123456789"), (None, "0123456789"), ("abcde", "   012345678  ")], "q string, a string")
    assert [r[0] for r in rows(df.select(Q.is_valid(F.col("q"), F.col("a"))))] == [True, False, False, False]
    with pytest.raises(ValueError):
        Q.select_segment(spark.createDataFrame([(-1,), (2,)], "segment_id int"), -1)
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    assert rows(Q.next_answer(turns)) == [(1, 1, "q", "a")]


def test_topic_description_order(spark):
    tax = spark.createDataFrame([(0, "m", None, "M1", "main"), (0, "m", "s", "S1", "sub"), (1, "x", "m", "M9", "other")], "position int, main string, sub string, code string, description string")
    asked = spark.createDataFrame([("m",), ("s",), ("S1",), ("M1",), ("no",)], "topic string")
    assert dict(rows(Q.topic_description(asked, tax))) == {"m": "main", "s": "sub", "S1": "sub", "M1": "M1", "no": "no"}
