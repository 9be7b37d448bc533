"""Nearest vectors in blocks and through an index, against all pairs in numpy."""

import numpy as np
import pytest

from tidemark.operators import nearest as N


def plain(queries, vectors, k, threshold=None, itself=True):
    def unit(v):
        v = np.array(v, float)
        size = np.sqrt((v**2).sum())
        return v / size if size else v

    out = []
    for q, a in queries:
        scored = sorted((-round(float(unit(a) @ unit(b)), 6), i) for i, b in vectors if itself or i != q)
        scored = [(s, i) for s, i in scored if threshold is None or -s >= threshold][:k]
        out += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def close(got, want):
    got = sorted((r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in got.collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


def vectors(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (max(1, clusters), dims))
    x = rng.normal(0, 0.35 if clusters else 1, (n, dims)) + (centres[rng.integers(0, clusters, n)] if clusters else 0)
    return [(i, v) for i, v in enumerate(np.round(x, 3).tolist())]


ROWS = "vec_id long, embedding array<double>"
ASKED = "query_id long, embedding array<double>"


@pytest.mark.parametrize("itself,threshold", [(True, None), (False, 0.2)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, itself, threshold):
    monkeypatch.setattr(N, "QUERY_ROWS", 7)
    monkeypatch.setattr(N, "BLOCK_ROWS", 30)
    v = vectors(300, 9, 1)
    v += [(1000 + i, x) for i, x in v[:20]]  # equal scores
    v += [(2000, [0.0] * 9)]
    odd = [(None, v[0][1]), (3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 9)]
    asked = v[::10] + [(5000, [0.0] * 9), (5001, v[3][1])]
    got = N.nearest(spark.createDataFrame([*asked, (None, v[0][1])], ASKED), spark.createDataFrame(v + odd, ROWS).repartition(3), 4, threshold, itself=itself)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    close(got, plain(asked, v, 4, threshold, itself))
    none = spark.createDataFrame([], ROWS)
    assert N.nearest(spark.createDataFrame(asked, ASKED), none, 3).count() == 0


def test_scopes_and_ids_of_text(spark):
    v = [(f"d{i}", x, "ab"[i % 2] if i % 7 else None) for i, x in vectors(60, 4, 2)]
    q = [(i, x, "ab"[i % 2] if i != 4 else None) for i, x in vectors(6, 4, 3)]
    got = N.nearest(spark.createDataFrame(q, ASKED + ", game string"), spark.createDataFrame(v, "vec_id string, embedding array<double>, game string").repartition(2), 3, scope="game")
    assert got.columns == ["query_id", "vec_id", "score", "game", "rank"]
    for game in "ab":
        want = plain([(i, x) for i, x, g in q if g == game], [(i, x) for i, x, g in v if g == game], 3)
        close(got.where(got.game == game), want)
    assert got.where("game is null").count() == 0


@pytest.mark.parametrize("clusters", [0, 12])
def test_an_index_finds_what_all_pairs_find(spark, tmp_path, monkeypatch, clusters):
    monkeypatch.setattr(N, "LIST_FILE", 40)
    v = vectors(2000, 16, 4, clusters)
    v += [(9000 + i, v[1][1]) for i in range(150)] + [(9500, [0.0] * 16)]  # a list of many copies, and a zero vector
    asked = [(i, x) for i, x in v[::100]] + [(7777, [0.0] * 16)]
    path = str(tmp_path / "index")
    table = spark.createDataFrame(v, ROWS).repartition(3)
    N.build(table, path)
    assert spark.read.parquet(f"{path}/lists").selectExpr("sum(size(ids)) n").first()["n"] == len(v)  # every row
    want = plain(asked, v, 5)
    q = spark.createDataFrame(asked, ASKED)
    close(N.search(path, q, 5, probes=3, exact=True), want)
    close(N.search(path, q, 5, probes=3, exact=True, threshold=0.4, itself=False), plain(asked, v, 5, 0.4, False))
    found = {(r["query_id"], r["vec_id"]) for r in N.search(path, q, 5).collect()}
    known = {(a, b) for a, b, _, _ in want if a != 7777}
    assert len(found & known) >= 0.9 * len(known)
    if clusters:  # where vectors have a structure, few lists hold what is near
        few = {(r["query_id"], r["vec_id"]) for r in N.search(path, q, 5, probes=8).collect()}
        assert len(few & known) >= 0.9 * len(known)


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    N.build(spark.createDataFrame([(1, None)], ROWS), path)
    assert N.search(path, spark.createDataFrame([(1, [1.0])], ASKED), 3).count() == 0


def test_recall_on_the_table_of_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding")
    path = str(tmp_path / "index")
    N.build(e, path)
    want = {(r["query_id"], r["vec_id"]) for r in N.nearest(asked, e, 5).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in N.search(path, asked, 5).collect()}
    assert len(want & found) >= 0.9 * len(want)


def test_queries_of_an_index_do_not_pass_through_the_driver(spark, tmp_path):
    path = str(tmp_path / "index")
    v = vectors(600, 8, 5)
    N.build(spark.createDataFrame(v, ROWS), path)
    got = N.search(path, spark.createDataFrame(v[::20], ASKED), 3, probes=2, exact=True)
    close(got, plain(v[::20], v, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [cell#" not in plan and "SortMergeJoin [cell#" in plan  # a query's row a list, lists grow with the table
