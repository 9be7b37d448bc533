"""Scores where documents are read, and metrics without lists that grow with the corpus."""

import pytest
from pyspark.sql import functions as F

from tests.test_index import DOCS, corpus, found, queries
from tidemark.catalog import metrics as C
from tidemark.operators import bm25 as B
from tidemark.operators import evaluation as E


@pytest.mark.parametrize("scope,together", [(None, 40), ("g", 40), (None, 1 << 20)])
def test_tasks_hand_on_their_best_and_lose_none(spark, monkeypatch, scope, together):
    monkeypatch.setattr(B, "_TOGETHER", together)
    rows = corpus(300, 1)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:80])] + [(2000, None, "g"), (2001, "", "h"), (2002, "f0 w1", None)]  # ties, and documents without tokens
    docs, asked = spark.createDataFrame(rows, DOCS).repartition(3), queries(spark, 25, 2)
    index, words = B.tokenized(docs, scope=scope), B.query_tokens(asked, scope=scope)
    handed = B.best(index, words, 4)
    assert found(B.top_k(handed, 4)) == found(B.top_k(B.score(index, words), 4))
    assert handed.count() <= 3 * 4 * 28 < B.score(index, words).count() / 3


def test_rows_of_one_id_stay_one_document(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "aa dd ee"), (3, "ff")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "aa")], "query_id long, text string")
    want = B.top_k(B.score(B.tokenized(docs), B.query_tokens(asked)), 3)
    assert found(B.retrieve(docs, asked, 3)) == found(want)
    assert B.retrieve(docs, asked, 3).where("doc_id = 1").count() == 1


def test_rounding_is_sparks(spark):
    x = [k / 20000 for k in range(3000)] + [12.34565, 0.00005, 1e9 + 0.00005]
    want = [r["r"] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 4).alias("r")).collect()]
    assert B._rounded(__import__("numpy").array(x)).tolist() == want


def test_relevant_ids_are_counted_not_listed(spark, tmp_path):
    item = "the old lighthouse keeper wrote letters"
    docs = [(i, f"{item} number{i}" if i % 2 else f"other words {i}", "en", "s") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "nothing alike")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = C.results(spark, str(tmp_path)).drop("error")
    one = rows.where("query_id = 1").first()
    assert len(one["relevant"]) <= 5 and (one["n_relevant"], one["n_different"]) == (30, 30)
    listed = spark.createDataFrame([(one["retrieved"], [str(i) for i in range(1, 60, 2)])], "retrieved array<string>, relevant array<string>")
    values = lambda df: [tuple(r[n] for n in E.NAMES) for r in E.per_query(df, (1, 3, 5)).orderBy("k").collect()]
    assert values(rows.where("query_id = 1")) == values(listed)
    assert [r["valid"] for r in E.per_query(rows, (3,)).orderBy("query_id").collect()] == [True, False]
