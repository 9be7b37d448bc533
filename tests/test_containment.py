"""Items in texts against plain Python: any length, hot grams, nulls, repeated rows, and more grams than tasks get."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import containment as C
from tidemark.operators import entities as E
from tidemark.operators import qa as Q


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_items_are_found_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MAX_GRAMS", most)
    monkeypatch.setattr(C, "_TOGETHER", 300)
    monkeypatch.setattr(C, "BROADCAST_IDS", 0 if most == 10 else 500_000)
    rng = random.Random(3)
    letters = "ab éß𠀀 c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    texts += [None, "", "common start " * 400 + "needle in it"]
    items = {t[k : k + n] for t in texts if t for k in (0, len(t) // 2) for n in (1, 2, 3, 4, 7, 8, 15, 16, 17, 40)} | {"".join(rng.choice(letters) for _ in range(n)) for n in range(1, 30)} | {"common start ", "needle in it", "nowhere at all in any"}
    items -= {""}
    docs = [(i % 140, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, texts[1])]
    asked = [(k, x) for k, x in enumerate(sorted(items))] + [(9000, None), (9001, "needle in it")]
    got = Q.containing(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, mark string").repartition(3), spark.createDataFrame(asked, "query_id long, item string"))
    assert set(got.columns) == {"doc_id", "text", "mark", "query_id", "item"}
    want = sorted((q, d if d is not None else -1, t) for q, x in asked if x for d, t in docs if t and x in t)
    assert sorted((r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in got.collect()) == want


def test_mentions_are_those_of_plain_python(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["Alpha", "ALPHA"]
    rows = [(k, "".join(rng.choice("abABc ") for _ in range(40)) + ("alphabet" if k % 5 == 0 else "")) for k in range(50)] + [(99, None)]
    got = E.mentions(spark.createDataFrame(rows, "qa_id long, t string"), spark.createDataFrame([(n,) for n in names], "entity string"), F.col("t"))
    want = {(k, n) for k, t in rows if t for n in names if n and n.lower() in t.lower()}
    assert {(r["qa_id"], r["entity"]) for r in got.collect()} == want


def test_no_text_is_shuffled_for_its_grams(spark):
    docs = spark.createDataFrame([(1, "some text")], "id long, text string")
    items = spark.createDataFrame([("text",), ("zz",)], "item string")
    found = C.contained(docs, items)
    assert [tuple(r)[::2] for r in found.collect()] == [(1, "text")]
