"""Files written and read again, and the plans from end to end with the offline providers."""

import json

import pytest

from pyspark.sql import functions as F

from tidemark.operators import bm25
from tidemark.plans import config as C
from tidemark.plans import evaluate as V
from tidemark.plans import generate as G
from tidemark.plans import index as I
from tidemark.plans.corpus import build_corpus, extract_entities
from tidemark.plans.providers import call
from tidemark.sources import readers as R
from tidemark.sources import writers as W
from tidemark.streaming import ingest as S

SEGMENTS = {"segments": [{"segment_id": 1, "start_date": "2024-01-01", "end_date": "2024-01-10", "type_distribution": {"a": 3, "b": 1}}, {"segment_id": 2, "start_date": "2024-01-10", "end_date": "2024-02-01"}]}


def sources(tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "2024-01-02_one.txt").write_text("Alpha Beta lives here. " * 30)
    (root / "deep" / "2024-01-15_two.md").write_text("See [Gamma](http://x) and Delta.")
    (root / "plain.txt").write_text("No date for Omega.")
    (root / "empty.txt").write_text("  \n ")
    (root / "other.csv").write_text("no")
    (tmp_path / "segments.json").write_text(json.dumps(SEGMENTS))
    return str(root), str(tmp_path / "segments.json")


def corpus(spark, tmp_path):
    root, config = sources(tmp_path)
    return build_corpus(R.read_source_files(spark, root), R.read_segments(spark, config), 50, 10)


def test_corpus_by_segment(spark, tmp_path):
    out = str(tmp_path / "corpus")
    for _ in range(2):  # the second time replaces the first
        W.write_corpus(corpus(spark, tmp_path) if not R.exists(spark, out) else corpus(spark, tmp_path / "again"), out)
    assert {r[0] for r in R.available_segments(spark, out).collect()} == {"1", "2", "timeless"}
    one = R.read_corpus(spark, out, 1, timeless=False)
    assert {r["title"] for r in one.collect()} == {"2024-01-02_one"} and one.count() == 3
    assert {r["title"] for r in R.read_corpus(spark, out, 2).collect()} == {"2024-01-15_two", "plain"}
    assert R.read_corpus(spark, out, timeless=False).count() == 4


def test_json_lines_with_broken_rows(spark, tmp_path):
    p = tmp_path / "qa.jsonl"
    p.write_text('{"question": "q1", "answer": "a"}\n\nbroken {\n{"question": "  "}\n')
    assert R.read_qa(spark, str(p)).count() == 2
    assert R.read_qa(spark, str(p), required=True).count() == 1
    assert R.read_qa(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_csv_cells(spark, tmp_path):
    p = tmp_path / "qa.csv"
    p.write_text('game_name,question,answer,question_topic,task_type,time,references,retrieved_docs,entities\ng,"a, ""b""",x,t,f,,"[""r""]","[{""id"":""1"",""score"":0.5}]",nonsense\n')
    row = R.read_qa_csv(spark, str(p)).first()
    assert (row["question"], row["references"], row["retrieved_docs"][0]["score"], row["entities"]) == ('a, "b"', ["r"], 0.5, [])


def test_taxonomy_and_submissions(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"m": {"code": "M", "description": "d", "subcategories": {"s": {"code": "S", "description": "e", "keywords": [], "examples": []}}}}))
    assert sorted(tuple(r) for r in R.read_taxonomy(spark, str(tmp_path / "t.json")).fillna("-").collect()) == [(0, "m", "-", "M", "d"), (0, "m", "s", "S", "e")]
    folder = tmp_path / "subs"
    folder.mkdir()
    game = dict(topk=3, recall=0.1, f1=0.2, ndcg=0.3, correctness=0.4, faithfulness=0.5)
    (folder / "a.json").write_text(json.dumps({"system_name": "a", "games": {"g": game}}))
    (folder / "example_submission.json").write_text(json.dumps({"system_name": "x", "games": {"g": game}}))
    (folder / "bad.json").write_text("{")
    assert [(r["system_name"], r["game"], r["recall"]) for r in R.read_submissions(spark, str(folder)).collect()] == [("a", "g", "0.1")]
    assert R.read_task_types(spark, str(tmp_path / "no.json")).count() == 0
    assert R.read_leaderboard(spark, str(tmp_path / "no.json"), "system_name string").count() == 0


def test_index_is_keyed_by_its_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "doc_id long, text string")
    index, root = bm25.tokenized(docs), str(tmp_path / "index")
    mark = W.corpus_fingerprint(docs, "doc_id", "text")
    assert not W.index_is_current(spark, root, mark)
    posted = bm25.postings(index)
    W.write_index(posted, bm25.corpus_stats(index), bm25.idf(posted, bm25.corpus_stats(index)), root, mark)
    assert W.index_is_current(spark, root, mark)
    assert not W.index_is_current(spark, root, W.corpus_fingerprint(docs.where("doc_id = 1"), "doc_id", "text"))
    W.delete(spark, root)
    assert not R.exists(spark, root)


def test_provider_failures(spark):
    def some(prompts):
        if "b" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string").coalesce(1)
    assert [r["o"] for r in call(df, "p", "o", "string", some, fallback="failed").collect()] == ["A", "failed", ""]


def test_generate_and_inherit(spark, tmp_path):
    chunks = corpus(spark, tmp_path).cache()
    templates = spark.createDataFrame([(f"t{i}", f"Alpha question {i} about Gamma", "a" if i < 6 else "b") for i in range(8)], "id string, template string, topic string")
    quota = spark.createDataFrame([("a", 3), ("b", 2)], "topic string, allocated long")
    done = spark.createDataFrame([("t0",)], "id string")
    pairs = G.generate(templates, quota, chunks, done, least=0, kind="bm25")
    got = pairs.collect()
    assert 0 < len(got) <= 5 and "t0" not in {r["template_id"] for r in got} and all(r["references"] for r in got)
    assert G.generate(templates, quota, chunks, done, least=0, threshold=-1.0).count() > 0  # dense retrieval, however far
    previous = spark.createDataFrame([(i, "a" if i % 2 else "b", ["Alpha"] if i < 4 else ["Other"]) for i in range(10)], "qa_id long, question_topic string, entities array<string>")
    types = spark.createDataFrame([("a", 3), ("b", 1)], "topic string, n long")
    kept = G.inherit(previous, spark.createDataFrame([("Alpha",)], "entity string"), types, 4, 2).collect()
    assert all(r["qa_id"] >= 4 and r["inherited_from"] == 1 for r in kept) and len(kept) == 4


def test_evaluate(spark):
    docs = spark.createDataFrame([("g", 1, "alpha beta gamma"), ("g", 2, "delta epsilon"), ("h", 3, "zeta eta")], "game_name string, doc_id long, text string")
    qa = spark.createDataFrame([(0, "g", "alpha beta", ["1"], "alpha beta"), (1, "h", "zeta", ["3"], "zeta"), (2, "none", "x", ["9"], "x")], "question_index long, game_name string, question string, ground_truth_doc_ids array<string>, ground_truth_answer string")
    for kind in ("bm25", "vector"):
        results = {r["question_index"]: r for r in V.retrieve_for(qa, docs, kind, 1).collect()}
        assert results[0]["retrieved_doc_ids"] == ["1"] and results[1]["retrieved_doc_ids"] == ["3"]
        assert results[2]["error"] and results[2]["retrieved_doc_ids"] == []
    retrieval, judged = V.evaluate(qa, docs, 1)
    assert {r["game_name"]: r["recall"] for r in retrieval.collect()} == {"g": 1.0, "h": 1.0, "none": 0.0}
    assert {r["game_name"] for r in judged.collect()} == {"all", "g", "h", "none"}


def test_stream_ingest(spark, tmp_path):
    root, config = sources(tmp_path)
    out = str(tmp_path / "chunks")
    for _ in range(2):  # nothing new the second time
        S.ingest(S.watch_sources(spark, root), R.read_segments(spark, config), out, str(tmp_path / "check"), size=50, overlap=10).awaitTermination(120)
    assert spark.read.parquet(out).groupBy("segment_key").count().count() == 3
    assert spark.read.parquet(out).count() == 5


def test_report(spark):
    assert [r[0] for r in W.markdown_report(spark.createDataFrame([(2, None), (1, 0.5)], "a int, b double")).collect()] == ["| 1 | 0.5 |", "| 2 | - |"]


def test_index_is_reused_and_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "cc dd aa")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa cc"), (2, "zz")], "query_id long, text string")
    root = str(tmp_path / "bm25")
    built = sorted(map(tuple, I.search(I.load_or_build(docs, root), asked).collect()))
    assert built == sorted(map(tuple, bm25.retrieve(docs, asked).collect()))
    before = spark.read.text(f"{root}/manifest").select("_metadata.file_modification_time").first()
    assert sorted(map(tuple, I.search(I.load_or_build(docs, root), asked).collect())) == built
    assert spark.read.text(f"{root}/manifest").select("_metadata.file_modification_time").first() == before


def test_refine_and_entities(spark):
    pairs = spark.createDataFrame([("q1", "a1", ["c"]), ("q2" * 200, "a2", ["c"]), ("q3", "a3", ["c"])], "question string, answer string, references array<string>")
    reply = lambda prompts: ['```json\n{"question": "Q", "answer": "A"}\n```' if "q1" in p else "no" for p in prompts]
    got = {r["original_question"]: (r["question"], r["answer"], r["optimized"]) for r in G.refine(pairs, reply).collect()}
    assert got == {"q1": ("Q", "A", True), "q2" * 200: ("q2" * 200, "a2", False), "q3": ("q3", "a3", False)}
    chunks = spark.createDataFrame([("1", "x", ["old"])], "id string, contents string, entities array<string>")
    assert extract_entities(chunks, lambda p: ['{"entities": [{"text": "A"}, {"text": " A"}, {"text": "B"}]}'] * len(p)).first()["entities"] == ["A", "B"]


def test_config(spark):
    c = C.load(C.RetrievalConfig, '{"k": 5, "unknown": 1}')
    assert c.model_key == "bm25_k5" and spark.range(1).select(C.as_column(c).alias("c")).first()["c"]["k"] == 5
    segments = spark.createDataFrame([(1, "a", "b")], "segment_id int, start_date string, end_date string")
    assert C.segment_info(spark, segments, 1)["start_date"] == "a" and C.segment_info(spark, segments, 2)["end_date"] == "unknown"


@pytest.mark.parametrize("size", ["7b", "64b", "128m"])
def test_lines_are_numbered_over_splits(spark, tmp_path, size):
    """Equal lines, blank and broken ones, lines longer than a split, several files and segments."""
    want = {}
    for key in ("1", "2", "timeless"):
        folder = tmp_path / "c" / f"segment_key={key}"
        folder.mkdir(parents=True)
        line = 0
        for name in ("a.jsonl", "b.jsonl"):
            rows = ['{"contents": "same"}'] * 5 + ["", "broken {", json.dumps({"id": "own" + key + name, "text": "x" * 300})] + ['{"contents": "same"}'] * (3 if name == "a.jsonl" else 0)
            (folder / name).write_text("\n".join(rows) + "\n")
            for r in rows:
                line += 1
                if "same" in r:
                    want[f"{'timeless' if key == 'timeless' else 'segment_' + key}_doc_{line}"] = "same"
                elif "own" in r:
                    want["own" + key + name] = "x" * 300
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = R.read_corpus(spark, str(tmp_path / "c"))
        got = [(r["id"], r["text"]) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == want
        assert {r["id"] for r in R.read_corpus(spark, str(tmp_path / "c"), 2, timeless=False).collect()} == {i for i in want if "segment_2" in i or "own2" in i}
        if size == "7b":
            assert spark.read.text(str(tmp_path / "c")).rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_submissions_are_files_of_several_tasks(spark, tmp_path):
    game = "named_struct('topk', 3, 'recall', '0.5')"
    rows = spark.range(40).selectExpr("concat('s', id) system_name", f"map('g', {game}) games").coalesce(1)
    path = str(tmp_path / "subs")
    W.write_submissions(rows, path)
    files = [p.name for p in (tmp_path / "subs").glob("*.json")]
    assert len(files) == 40 and len({n.split("-")[1] for n in files}) > 1  # a file a system, not all by one task
    assert sorted(r["system_name"] for r in R.read_submissions(spark, path).collect()) == sorted(f"s{k}" for k in range(40))
