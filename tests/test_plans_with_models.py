"""Plans around models: dense retrieval with a threshold, personas, failures, runs written under their names; and what readers promise."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as X
from tidemark.operators import allocation as L
from tidemark.operators import bm25
from tidemark.operators import qa as Q
from tidemark.operators import vector as D
from tidemark.plans import evaluate as V
from tidemark.plans import generate as G
from tidemark.plans.corpus import build_corpus
from tidemark.plans.providers import FAILED, call
from tidemark.sources import readers as R
from tidemark.sources import writers as W


def _letters(prompts):
    """A vector by letters, so that texts with other letters are far apart."""
    return [[float(p.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for p in prompts]


def test_generation_retrieves_what_is_near_enough(spark):
    corpus = spark.createDataFrame([("c1", "aaaa bbbb", "2024-01-01", ["Alpha", "Beta"]), ("c2", "zzzz yyyy", "2024-02-01", ["Gamma"])], "id string, contents string, extracted_date string, entities array<string>")
    templates = spark.createDataFrame([("t1", "aaa bb", "x", "meaning", ["p"]), ("t2", "qqqq", "x", None, None)], "id string, template string, topic string, description string, placeholders array<string>")
    quota = spark.createDataFrame([("x", 5)], "topic string, allocated long")
    ask = lambda prompts: [f"question: {p.splitlines()[-1]} alpha?\nanswer: aab" if "aaa" in p else "question: qqqqqqqqqqqqqqqq\nanswer: qqqqqqqq" for p in prompts]
    seen = lambda prompts: ["It says alpha and more, " + ("as a pilot" if "pilot" in p else "as nobody") for p in prompts]
    personas = spark.createDataFrame([(1, "a pilot: aaaa bbb", "aa", "x|y"), (2, "zzzz", "zz", "z")], "persona_id long, player_description string, source_content string, source_topic string")
    out = G.generate(templates, quota, corpus, question=ask, answer=seen, least=0, vectors=_letters, threshold=0.5, personas=personas)
    rows = {r["template_id"]: r for r in out.collect()}
    assert set(rows) == {"t1"}  # nothing is near enough to t2
    assert rows["t1"]["retrieved_doc_ids"] == ["c1"] and rows["t1"]["entities"] == ["Alpha"] and rows["t1"]["time"] is not None
    assert rows["t1"]["role_data"]["persona_id"] == 1 and rows["t1"]["role_data"]["semantic_similarity"] >= 0.6 and "as a pilot" in rows["t1"]["answer"]
    assert G.generate(templates, quota, corpus, question=ask, answer=seen, least=0, vectors=_letters, threshold=0.0, test_size=1).count() == 1
    far = D.best_match(D.similarities(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"))).first()
    assert far["vec_id"] is None and far["score"] == 0.0


def test_blocks_of_queries_meet_all_vectors(spark, monkeypatch):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0], "a" if i % 2 else "b") for i in range(40)], "vec_id long, embedding array<double>, game_name string")
    asked = e.withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in D.similarities(asked, e.drop("game_name")).collect()}
    monkeypatch.setattr(D, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in D.similarities(asked, e.drop("game_name")).collect()} == whole and len(whole) == 1600
    assert D.similarities(asked, e, "game_name").count() == 800


def test_failures_have_their_text(spark):
    def no(prompts):
        raise RuntimeError

    rows = spark.createDataFrame([(0, "q", ["c"])], "question_index long, question string, contexts array<string>")
    got = V.answer(rows, no, wait=0.0).first()
    assert got["answer"] == FAILED and got["error"] == "generation failed"
    tried = []

    def twice(prompts):
        tried.append(1)
        if len(tried) < 2:
            raise RuntimeError
        return ["ok"] * len(prompts)

    assert call(rows.coalesce(1), "question", "o", "string", twice, fallback="f", wait=0.0).first()["o"] == "ok"


def test_instructions_come_first(spark):
    from tidemark.plans import prompts as T

    asked = T.instructed(lambda prompts: [p.split("\n")[0] for p in prompts], T.ANSWER)
    rows = spark.createDataFrame([(0, "q", ["c"])], "question_index long, question string, contexts array<string>")
    assert V.answer(rows, asked).first()["answer"] == T.ANSWER


def test_runs_are_written_and_timed(spark, tmp_path):
    docs = spark.createDataFrame([("g", 1, "alpha beta gamma"), ("h", 1, "delta epsilon"), ("h", 2, "zeta")], "game_name string, doc_id long, text string")
    qa = spark.createDataFrame([(1, "h", "delta"), (0, "g", "alpha")], "question_index long, game_name string, question string")
    found = V.retrieve_to(str(tmp_path / "r"), qa, docs, k=1).collect()
    assert [r["question_index"] for r in found] == [0, 1] and len({r["retrieval_time"] for r in found}) == 1 and found[0]["retrieval_time"] > 0
    assert [r["contexts"] for r in found] == [["alpha beta gamma"], ["delta epsilon"]]  # ids are unique in their game only
    assert W.run_name("generation", "org/a-b") == "generation_org_a_b"
    path = V.answer_to(str(tmp_path), spark.createDataFrame([(0, "q", ["c. d"])], "question_index int, question string, contexts array<string>"), "org/a-b")
    assert path.endswith("generation_org_a_b") and R.read_generation_results(spark, path).count() == 1
    with pytest.raises(ValueError):
        V.retrieve_for(qa, docs, "other")


def test_validation_and_selection(spark):
    pairs = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert Q.validate_pairs(pairs, pairs) == []
    assert Q.validate_pairs(pairs.limit(0), pairs.drop("answer")) == ["results: no rows", "ground truth: no field answer"]
    with pytest.raises(ValueError):
        Q.select_segment(spark.createDataFrame([(1,)], "segment_id int"), 2)
    assert L.test_sample(spark.range(9).withColumnRenamed("id", "k"), "k", 4).count() == 4


def test_items_in_texts(spark):
    docs = spark.createDataFrame([(1, "xone two three four five six sevenx"), (2, "one two  three four five six seven"), (3, "ab"), (4, None), (5, "b a b a b a b a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "ab"), (3, None), (4, "a b a b a b a b")], "query_id long, item string")
    assert {(r["query_id"], r["doc_id"]) for r in Q.containing(docs, items).collect()} == {(1, 1), (2, 3), (4, 5)}
    assert Q.containing(docs.limit(0), items).count() == 0
    many = spark.range(10_000).selectExpr("id as query_id", "if(id = 77, 'ab', concat('q', id, 'z')) as item")  # short items without end
    assert {(r["query_id"], r["doc_id"]) for r in Q.containing(docs, many).collect()} == {(77, 3)}


def test_segmenters(spark):
    rows = spark.createDataFrame([("游戏攻略guide 好",)], "t string")
    assert rows.select(X.tokens(F.col("t")).alias("w")).first()["w"] == ["游戏攻略guide"]
    assert rows.select(X.tokens(F.col("t"), X.han_pairs).alias("w")).first()["w"] == ["游戏", "戏攻", "攻略", "guide"]
    docs = spark.createDataFrame([(1, "新游戏来了"), (2, "别的")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "游戏")], "query_id long, text string")
    assert [r["doc_id"] for r in bm25.retrieve(docs, asked, segment=X.han_pairs).collect()] == [1]


def test_chunks_of_nothing_and_of_long_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "w " * 5000)], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", X.chunks(F.col("t"), 100, 20).alias("c")).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 63 and got[3][-1]["contents"].count("w") == 40


def test_html_of_any_kind(spark):
    rows = spark.createDataFrame([("caf&eacute; &#233;<BR/>x<SCRIPT>no</SCRIPT>",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(H.clean(F.col("t"))).collect()] == ["café é\nx", "plain", ""]
    assert rows.select(X.html_text(F.col("t"))).first()[0] == "caf&eacute; &#233;\nx"


def test_ids_that_stay(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.txt").write_text("Alpha here")
    files = R.read_source_files(spark, str(tmp_path / "in"))
    segments = spark.createDataFrame([(0, 1, "2024-01-01", "2024-02-01")], "position int, segment_id int, start_date string, end_date string")
    ids = [r["id"] for r in build_corpus(files, segments).collect()]
    assert len(set(ids)) == 2 and sorted(ids) == sorted(r["id"] for r in build_corpus(files.repartition(5), segments).collect())
    corpus = tmp_path / "corpus" / "segment_key=1"
    corpus.mkdir(parents=True)
    (corpus / "c.jsonl").write_text("\n".join(json.dumps(x) for x in ({"contents": "one"}, {"id": "own", "text": "two"})) + "\nbroken {\n")
    got = {r["text"]: r["id"] for r in R.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert got["two"] == "own" and got["one"] == "segment_1_doc_1" and len(got) == 2
    assert got == {r["text"]: r["id"] for r in R.read_corpus(spark, str(tmp_path / "corpus")).repartition(3).collect()}
    (tmp_path / "other" / "segment_4").mkdir(parents=True)
    assert [r[0] for r in R.available_segments(spark, str(tmp_path / "other")).collect()] == ["4"]


def test_an_index_of_another_corpus_stands_until_the_new_one_is_whole(spark, tmp_path):
    from tidemark.plans import index as I

    root = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cc")], "query_id long, text string")
    before = I.load_or_build(first, root)
    before.log.stage(rows=second)  # a part without a commit
    assert I.search(I.Index(spark, root), asked).count() == 0
    now = I.load_or_build(second, root)
    assert I.search(now, asked).first()["doc_id"] == 2 and I.search(before, asked).count() == 0
    assert I.load_or_build(second, root).version == now.version == 2 and I.load_or_build(first, root).version == 3
    vectors = str(tmp_path / "vectors")
    items = spark.createDataFrame([(1, "ab")], "vec_id long, text string")
    made = []
    make = lambda rows: made.append(1) or rows.select("vec_id", F.array(F.lit(1.0)).alias("embedding"))
    for force in (False, False, True):
        assert D.load_or_embed(items, vectors, make, force).count() == 1
    assert len(made) == 2


def test_entities_take_two_passes_of_prompts_alone(spark):
    from tidemark.plans.corpus import extract_entities

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        kinds = {"W": "" , "L": "shown", "E": '{"entities": []}'}
        out = []
        for p in prompts:
            if "plain" in p or p.startswith("List the named entities of this text"):
                out.append('{"entities": [{"text": "Direct"}]}' if p.startswith("List the named entities of this text") else "")
            else:
                out.append("ex" if p.startswith("W") else kinds[p[0]])
        return out

    rows = spark.createDataFrame([("plain", 1), ("other", 2), ("x" * 4000, 3)], "contents string, k int")
    got = extract_entities(rows, model)
    assert got.columns == ["contents", "k"] and extract_entities(rows.withColumn("entities", F.array(F.lit("old"))), model).where("entities[0] = 'Direct'").count() == 3
    plan = extract_entities(rows.withColumn("entities", F.array()), model)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython [") == 2  # was four passes of whole rows
    calls = spark.sparkContext.accumulator(0)

    def counted(prompts):
        calls.add(len(prompts))
        return ["a" if "o" in p else "b" for p in prompts]

    found = call(rows, "contents", "o", "string", counted).where("o = 'b' and k > 1")
    assert [r["k"] for r in found.collect()] == [3] and calls.value == 3  # once a row, though a filter reads the reply


def test_entities_of_whole_texts(spark):
    from tidemark.plans.corpus import extract_entities

    def model(prompts):
        """No entities behind the examples of a text that begins with an a; else how the prompt begins and ends."""
        return ["no" if p.startswith("Examples") and p.split("\n")[-1].startswith("a") else '{"entities": [{"text": "' + p[:8] + p.split()[-1] + '"}]}' for p in prompts]

    rows = spark.createDataFrame([("a " + "x " * 30_000 + "Oslo", []), ("b " + "x " * 30_000 + "Rome", []), (None, [])], "contents string, entities array<string>")
    got = {(r["contents"] or "none")[0]: r["entities"] for r in extract_entities(rows, model).collect()}
    assert got["a"] == ["List theOslo"] and got["b"] == ["ExamplesRome"] and len(got["n"]) == 1
    seen = spark.sparkContext.accumulator(0)

    def counted(prompts):
        seen.add(sum(len(p) > 60_000 for p in prompts))
        return ["no"] * len(prompts)

    extract_entities(rows.where("contents is not null"), counted).collect()
    assert seen.value == 6  # examples, behind them, and by itself, for both
