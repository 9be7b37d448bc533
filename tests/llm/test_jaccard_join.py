"""The exact similarity join against all pairs in plain Python, with few and with many cuts of its regions."""

from __future__ import annotations

import random

import pytest

from tests.llm import brute
from tests.llm.test_contracts import corpus, frame, words  # noqa: F401
from tidemark.llm import jaccard_join


def _family(rng, first, n, length, edits):
    """Chains and stars of edits of one text, some of them far from it."""
    base = words(rng, length)
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(w)))
        if k % 3 == 0:
            base = w
    return rows


def _hard(rng):
    rows = _family(rng, 0, 150, 90, 5) + _family(rng, 200, 60, 40, 3) + _family(rng, 300, 80, 200, 14)
    boilerplate = [" ".join(words(rng, 12)) for _ in range(6)]
    rows += [(500 + k, " ".join(rng.sample(boilerplate, rng.randrange(2, 6)))) for k in range(80)]  # nothing but common passages
    rows += [(700 + k, " ".join(words(rng, rng.randrange(1, 8)))) for k in range(60)]
    rows += [(800 + k, rng.choice(["One Two", "one two", "one two three", "a", "A"])) for k in range(12)]
    return rows


def test_components_are_those_of_all_pairs(spark, corpus):  # noqa: F811
    got = jaccard_join.similarity_components(frame(spark, corpus))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.near_duplicates(corpus, 3, 90)


@pytest.mark.parametrize("cell,pivots,seed", [(64, 8, 1), (4, 3, 2), (2, 2, 3)])
def test_components_of_hard_groups(spark, monkeypatch, cell, pivots, seed):
    rows = _hard(random.Random(seed))
    for name, value in (("CELL", cell), ("PIVOTS", pivots), ("PART", 16), ("BROADCAST_IDS", 0 if seed == 3 else 500_000), ("GAIN", 8 if seed == 2 else 2), ("NARROW", 0 if seed == 2 else 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "PROGRESS", -9)
    got = jaccard_join.similarity_components(frame(spark, rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.near_duplicates(rows, 3, 90)


def test_components_at_the_edges(spark):
    text = "one two three four five six"
    schema = "doc_id long, text string, key string, cls string, region string"
    rows = [(1, text), (1, "seven eight nine"), (2, "seven eight nine"), (2, text), (1, text), (None, text), (3, None), (4, " "), (5, "x" * 2_000_000), (6, "w " * 100_000), (7, "w w w w")]
    docs = spark.createDataFrame([(*r, "k", "c", "r") for r in rows], schema).repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(docs).collect())
    assert got == [(0, 4, None), (1, 1, 1), (1, 4, 1), (1, 4, 1), (2, 1, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (7, 1, 6)]
    assert jaccard_join.similarity_components(docs.limit(0)).count() == 0


def test_stars_are_the_components(spark):
    from tidemark.llm._graph import components

    rng = random.Random(7)
    for n, m in ((60, 40), (200, 190), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1030 if m else 1000)]
        table = spark.createDataFrame(edges, "a long, b long")
        assert {tuple(r) for r in components(table, by_stars=True).collect()} == {tuple(r) for r in components(table).collect()}
