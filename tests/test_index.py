"""The index of parts: searches equal scoring every pair, updates equal a full rebuild, and only commits count."""

import random

import pytest

from tidemark.operators import bm25
from tidemark.plans import index as I
from tidemark.sources.commits import CommitLog, Conflict, left_to_do, progress


def corpus(n, seed, common=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    frequent = [f"f{k}" for k in range(common)]
    return [(i, " ".join(rng.choice(frequent) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randrange(1, 60))), "gh"[i % 2]) for i in range(n)]


DOCS = "doc_id long, text string, g string"


def found(rows):
    return sorted((r["scope"], r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in rows.collect())


def queries(spark, n, seed):
    rng = random.Random(seed)
    asked = [(i, " ".join([rng.choice([f"w{rng.randrange(420)}", f"f{rng.randrange(12)}"]) for _ in range(rng.randrange(0, 9))] + ["f0 f1 f1"]), "gh"[i % 2]) for i in range(n)]
    return spark.createDataFrame([*asked, (900, None, "g"), (901, "f0 f0 f1", "g"), (902, "nowhere", "h")], "query_id long, text string, g string")


@pytest.mark.parametrize("scope,seeds,hot", [(None, 20, 50), ("g", 5, 10**9), (None, 1000, 4096)])
def test_pruned_search_is_the_whole_one(spark, tmp_path, monkeypatch, scope, seeds, hot):
    monkeypatch.setattr(I, "SEEDS", seeds)
    monkeypatch.setattr(I, "HOT", hot)
    rows = corpus(500, 1)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:30])] + [(2000, None, "g"), (2001, "", "h")]  # ties, and documents without tokens
    docs, asked = spark.createDataFrame(rows, DOCS).repartition(3), queries(spark, 25, 2)
    index = I.load_or_build(docs, str(tmp_path / "i"), scope)
    want = found(bm25.retrieve(docs, asked, 4, scope=scope))
    assert found(I.search(index, asked, 4, scope)) == want
    run = I.Search(index, bm25.query_tokens(asked, scope=scope), 4)
    pairs = run.pairs().first()
    assert pairs["scored_pairs"] <= pairs["all_pairs"]
    if seeds == 20:  # long lists of frequent tokens aren't scored
        assert pairs["scored_pairs"] < 0.7 * pairs["all_pairs"] and pairs["candidates"] < pairs["scored_pairs"]


def test_updates_are_those_of_a_full_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "HOT", 40)
    monkeypatch.setattr(I, "SEEDS", 10)
    asked, root = queries(spark, 20, 3), str(tmp_path / "i")
    rows = corpus(300, 4)
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    I.update(frame(rows), root)
    changed = [(i, "w1 w2 f0" if i % 10 == 0 else t, g) for i, t, g in rows if i % 7] + corpus(340, 5)[300:]
    index = I.update(frame(changed), root)
    assert len(index.parts) == 2 and index.spark.read.parquet(f"{root}/data/{index.parts[1]}/documents").where("dl is not null").count() < 120
    direct = lambda rows: found(bm25.retrieve(frame(rows), asked, 3))
    assert found(I.search(index, asked)) == direct(changed)
    more = [(5000 + i, "f1 w3 w9", "g") for i in range(3)]
    index = I.update(frame(more), root, whole=False)
    assert found(I.search(index, asked)) == direct(changed + more)
    index = I.delete(root, spark.createDataFrame([("all", 5001), ("all", changed[0][0]), ("all", 999_999)], "scope string, doc_id long"))
    left = [r for r in changed + more if r[0] not in (5001, changed[0][0])]
    assert len(index.parts) == 4 and found(I.search(index, asked)) == direct(left)
    before = index
    index = I.merge(spark, root)
    assert len(index.parts) == 1 and found(I.search(index, asked)) == direct(left) == found(I.search(before, asked))
    assert I.update(frame(left), root).version == index.version  # nothing has changed
    assert len(index.log.vacuum()) == 4 and found(I.search(index, asked)) == direct(left)
    assert found(I.search(I.load_or_build(frame(rows), root, force=True), asked)) == direct(rows)


def test_a_batch_counts_from_its_commit_on(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    schema = "id long, x string"
    batch = lambda ids: spark.createDataFrame([(i, f"x{i}") for i in ids], schema)
    assert log.read(schema).count() == 0 and left_to_do(batch(range(5)), log, "id").count() == 5
    log.append(batch(range(3)))
    stopped = log.stage(rows=batch(range(3, 6)))  # a run ends here, before its commit
    assert sorted(r["id"] for r in log.read().collect()) == [0, 1, 2]
    rest = left_to_do(batch(range(8)), log, "id")
    log.append(rest, note="resumed")
    assert sorted(r["id"] for r in log.read().collect()) == list(range(8))  # nothing is lost, nothing is there twice
    assert progress(log, "id").first().asDict() == {"version": 2, "batches": 2, "generated_count": 8, "done": 8}
    assert log.records()[1]["info"] == {"note": "resumed"}
    with pytest.raises(Conflict):
        log.commit([stopped], after=1)
    held = log.read()
    assert log.compact() == 3 and held.count() == 8 and log.read().count() == 8 and len(log.state()[1]) == 1
    assert stopped in log.vacuum() and log.read().count() == 8


def test_an_index_is_written_without_a_shuffle_of_its_postings(spark, tmp_path):
    rows = [(1, "bb aa bb", "g"), (2, None, "g"), (3, "", "h"), (4, "Aa x éé éé", "h")]
    hits = I._hits(I._mark(spark.createDataFrame(rows, DOCS), None), None)
    got = sorted((r["doc_id"], r["dl"], r["token"], r["tf"]) for r in hits.collect())
    assert got == [(1, 3, "", 1), (1, 3, "aa", 1), (1, 3, "bb", 2), (2, 0, "", 1), (3, 0, "", 1), (4, 3, "", 1), (4, 3, "aa", 1), (4, 3, "éé", 2)]
    assert "Exchange" not in hits._jdf.queryExecution().toString()
    index = I.update(spark.createDataFrame(rows, DOCS), str(tmp_path / "i"))
    written = spark.read.parquet(f"{index.log.root}/data/{index.parts[0]}/postings")
    assert written.where("(mark is null) <> (token <> '')").isEmpty()  # a text's hash stands beside its document alone


def test_runs_of_documents_are_inverted(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(I, "RUN_TOKENS", 3)
    docs = [("g", 1, 11, ["bb", "aa", "bb"]), ("h", 2, 12, []), ("g", 3, 13, ["aa"]), ("g", 4, 14, ["éé", "aa"]), ("g", 5, 15, [])]
    names = ["scope", "doc_id", "mark", "tokens"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in docs], pa.schema([("scope", pa.string()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    rows = [r for b in I._runs(batch.slice(*x) for x in ((0, 0), (0, 1), (1, 1), (2, 3))) for r in b.to_pylist()]
    assert len({r["run"] for r in rows}) == 3 and all(r["df"] == len(r["p"]) and r["max_tf"] == max(x["tf"] for x in r["p"]) and r["min_dl"] == min(x["dl"] for x in r["p"]) for r in rows)
    got = sorted((r["scope"], x["doc_id"], x["dl"], r["token"], x["tf"]) for r in rows for x in r["p"] if r["token"])
    assert got == [("g", 1, 3, "aa", 1), ("g", 1, 3, "bb", 2), ("g", 3, 1, "aa", 1), ("g", 4, 2, "aa", 1), ("g", 4, 2, "éé", 1)]
    assert sorted((m, x["doc_id"], x["dl"]) for r in rows if not r["token"] for x, m in zip(r["p"], r["mark"])) == [(10 + d[1], d[1], len(d[3])) for d in docs]
    assert all([x["place"] for x in r["p"]] == list(range(r["df"])) for r in rows if not r["token"])


def test_postings_stay_where_they_are_whatever_is_superseded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "HOT", 40)
    root, rows = str(tmp_path / "i"), corpus(300, 6)
    I.update(spark.createDataFrame(rows, DOCS).repartition(3), root)
    now = [(i, t if i % 3 else f"w1 {t}", g) for i, t, g in rows[20:]]
    index = I.update(spark.createDataFrame(now, DOCS), root)
    files = [r["f"] for r in spark.read.parquet(f"{root}/data/{index.parts[0]}/postings").selectExpr("input_file_name() f").distinct().collect()]
    assert len(files) == 3  # a task writes one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counting = index.each(index.lists())
        assert "hashpartitioning" not in counting._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, counting.select("scope", "token", "doc_id", "dl", "tf").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = bm25.postings(bm25.tokenized(spark.createDataFrame(now, DOCS)))
    assert got == sorted(map(tuple, want.select("scope", "token", "doc_id", "dl", "tf").collect()))
    few = spark.createDataFrame([("all", "w1"), ("all", "f0")], "scope string, token string")
    assert sorted(map(tuple, index.each(index.lists(few)).select("scope", "token", "doc_id", "dl", "tf").collect())) == [r for r in got if r[1] in ("w1", "f0")]
    merged = I.merge(spark, root)
    assert sorted(map(tuple, merged.each(merged.lists()).select("scope", "token", "doc_id", "dl", "tf").collect())) == got
    places = {(r["run"], r["place"]) for r in merged.documents().collect()}
    assert len(places) == 280
