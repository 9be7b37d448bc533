"""Divergences of sources and hard negatives against plain Python, with nulls, ties, copies, long rows and empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import hard_negatives, source_divergence

DOCS = "text string, lang string, source string, value string, n string, part string"
VECTORS = "vec_id long, embedding array<float>, label int, score string, no string, v string"


def plain_audit(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(brute.LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(count):
            total = sum(count[t] for t in kept)
            return [1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s)
            terms = sorted((-f(a, b), t.encode()) for a, b, t in zip(p[s], q, kept) if counts[lang, s][t] and a > b)[:top]
            out |= {(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)}
    return out


def _documents():
    rng = random.Random(5)
    vocabulary = "Alpha beta BETA ünï ſtone x1y don't 日本 zeta-eta É é AΩ".split()
    rows = [(" ".join(rng.choice(vocabulary[: 4 + k % 9]) for _ in range(rng.randrange(30))), rng.choice(["aa", "bb", None]), rng.choice(["s", "t", "é", "", None])) for k in range(160)]
    return [*rows, (None, "aa", "silent"), ("12 !!", "aa", "silent"), ("only one here", "cc", "x"), ("", "cc", "y"), (None, None, None), *[("same same", "bb", "t")] * 12, ("beta " * 300_000, "aa", "s")]


@pytest.mark.parametrize("pairs", [2_000_000, 8])
def test_audit_is_the_plain_one(spark, monkeypatch, pairs):
    monkeypatch.setattr(source_divergence, "BLOCK_PAIRS", pairs)
    rows = _documents()
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).repartition(5)
    monkeypatch.setattr(source_divergence, "PART_ENTRIES", 7)  # several parts a language
    got = source_divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows)
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_hashes_that_collide_are_told_apart():
    data = b"abc abd abc a abd x"
    starts, ends = np.array([0, 4, 8, 12, 14, 18]), np.array([3, 7, 11, 13, 17, 19])
    number, of = source_divergence.grouped(data, starts, ends, digest=lambda s: 7)
    assert [of[k] for k in number] == [b"abc", b"abd", b"abc", b"a", b"abd", b"x"]


def test_shares_of_very_many_occurrences():
    n = np.array([0, 5, 40_000_000_000])
    assert source_divergence.share(n, np.int64(40_000_000_005), 3).tolist() == [1 + 10**9 * (x + 2) // (40_000_000_005 + 6) for x in n.tolist()]


def plain_negatives(rows, is_anchor, k=3, positives=5, low=50, high=95):
    ok = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in ok:
        if not is_anchor(i):
            continue
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, z) for j, w, z in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            s = -s
            fit = [(n, m) for m, n, z in scored if z != y and low * s <= -100 * m and -100 * m <= high * s][:k]
            out += [(i, j, r, n, s, -m) for r, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_are_the_plain_ones(spark, monkeypatch):
    rng = random.Random(6)
    vector = lambda: [round(rng.gauss(0.02, 0.1), 3) for _ in range(8)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 2)]  # equal scores
    rows += [(600, None, 1), (601, [0.1, None] * 4, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (604, vector(), None), (None, vector(), 1), (610, [], 1), (620, [0.5, 0.25], 2), (630, [0.0] * 8, 2)]
    rows += [(i, v, y) for i, v, y in rows[:40:5]]  # repeated rows, anchors among them
    rows += [(640, [3e38] * 8, 1), (641, [-7e7, 9e9] + [1.0] * 6, 2), (650, [200_000.0] * 8, 1)]
    to_float = lambda v: v and [x if x is None else float(np.float32(x)) for x in v]
    rows = [(i, to_float(v), y) for i, v, y in rows]
    table = spark.createDataFrame([(*r, "s", "n", "v") for r in rows], VECTORS).repartition(4)
    for name, size in (("ANCHOR_BLOCK", 7), ("ROW_BLOCK", 50), ("SLICE_ROWS", 130)):
        monkeypatch.setattr(hard_negatives, name, size)
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(table.limit(0), "vec_id = 0").count() == 0
    assert hard_negatives.mine(table.where("vec_id = 10"), "vec_id = 10").count() == 0
