"""Functions against hand-computed cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import parsing as P
from tidemark.functions import text as X
from tidemark.functions.html import to_text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("before,after", [("see [a b](http://x) and [c](d)", "see a b and c"), ("[plain] text", "[plain] text")])
def test_links(spark, before, after):
    assert one(spark, X.strip_md_links(F.col("t")), t=before) == after


@pytest.mark.parametrize("before,after", [("a \t b\n\n\n\n c ", "a b\n\nc"), ("  x  \n  y  ", "x\ny"), ("", "")])
def test_whitespace(spark, before, after):
    assert one(spark, X.normalize_whitespace(F.col("t")), t=before) == after


def test_clean_html_null_is_empty(spark):
    assert one(spark, X.clean_html(F.lit(None).cast("string"))) == ""
    assert one(spark, X.clean_html(F.col("t")), t="<p>a &amp; b[3]</p><script>x</script><ul><li>c</li></ul>") == "a & b\n\n- c"


def test_parsed_text():
    assert to_text("<table><tr><td>a</td><td>b</td></tr></table><script>no</script>&amp;lt;").split() == ["a", "b", "<"]
    assert to_text(None) == ""


@pytest.mark.parametrize("n,size,overlap,starts", [(0, 4, 1, []), (3, 4, 1, [0]), (4, 4, 1, [0]), (5, 4, 1, [0, 3]), (10, 4, 1, [0, 3, 6]), (11, 4, 1, [0, 3, 6, 9])])
def test_chunks_cover(spark, n, size, overlap, starts):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, X.chunks(F.col("t"), size, overlap), t=" ".join(words))
    assert [(c["i"], c["contents"].split()) for c in got] == [(k, words[s : s + size]) for k, s in enumerate(starts)]


def test_chunks_reject_overlap():
    with pytest.raises(ValueError):
        X.chunks(None, 10, 10)


def test_cap_and_tokens(spark):
    assert one(spark, X.cap(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, X.cap(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, X.tokens(F.col("t")), t="The É-team, a b2_c x") == ["the", "team", "b2_c"]


@pytest.mark.parametrize(
    "text,body",
    [
        ('x <json> {"a":1} </json> ```json {"b":2}```', '{"a":1}'),
        ('x ```json\n{"b":2}\n```', '{"b":2}'),
        ('```text {"c":3} ```', '{"c":3}'),
        ('so {"d":{"e":4}} end', '{"d":{"e":4}}'),
        ("nothing", ""),
    ],
)
def test_json_ladder(spark, text, body):
    assert one(spark, P.json_body(F.col("t")), t=text) == body


@pytest.mark.parametrize("text", ['{"a": "b...', '{"a": {"b": "c"...', '{"a": "b"}'])
def test_truncated_is_json(spark, text):
    json.loads(one(spark, P.repair_truncated(F.col("t")), t=text))


@pytest.mark.parametrize(
    "text,question,answer",
    [("Question: a\nAnswer: b\nquestion: c", "c", "b"), ("first\nsecond\nthird", "first", "second\nthird"), ("only", "T", "only"), ("question：全 \nanswer：角", "全", "角")],
)
def test_hypothetical(spark, text, question, answer):
    got = one(spark, P.hypothetical(F.col("t"), F.lit("T")), t=text)
    assert (got["question"], got["answer"]) == (question, answer)


def test_prefixes_and_fence(spark):
    assert one(spark, P.strip_prefixes(F.col("t")), t="Answer:  The answer is\n 42 ") == "42"
    assert one(spark, P.strip_fence(F.col("t")), t="```json\n{}\n```") == "{}"


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"question":"q","answer":"a"}', ("q", "a", "json")),
        ("Q: q1\nA: a1", ("q1", "a1", "lines")),
        ("What is it?\nA thing.", ("What is it?", "A thing.", "heuristic")),
        ("nothing here", (None, None, "none")),
    ],
)
def test_qa_record(spark, text, expected):
    assert tuple(one(spark, P.qa_record(F.col("t")), t=text)) == expected


def test_entity_list_and_template(spark):
    assert [e["text"] for e in one(spark, P.entity_list(F.col("t")), t='x {"entities":[{"text":"A"},{"text":"B"}]} y')] == ["A", "B"]
    assert one(spark, P.entity_list(F.col("t")), t="no") == []
    assert tuple(one(spark, P.template_record(F.col("t")), t="Template: how?"))[0::2] == ("how?", "lines")


def metric(spark, f, retrieved, relevant, *args):
    row = spark.createDataFrame([(retrieved, relevant)], "r array<string>, g array<string>")
    return row.select(f(F.col("r"), F.col("g"), *args).alias("x")).first()["x"]


def test_retrieval_metrics_with_repeats(spark):
    r, g = ["a", "a", "b"], ["a", "b", "b", "c"]
    assert metric(spark, M.recall, r, g, 3) == 2 / 4
    assert metric(spark, M.precision, r, g, 3) == 2 / 3
    assert metric(spark, M.f1, r, g, 3) == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert metric(spark, M.ndcg, r, g, 3) == pytest.approx((1 + 0.5) / ideal)
    assert metric(spark, M.ndcg, r, g, 3, False) == pytest.approx((1 + 1 / math.log2(3) + 0.5) / ideal)
    assert metric(spark, M.ndcg, ["a", "a"], ["a"], 2, False) > 1
    for f in (M.recall, M.precision, M.f1, M.ndcg):
        assert metric(spark, f, [], ["a"], 3) == 0 and metric(spark, f, ["a"], [], 3) == 0


@pytest.mark.parametrize("raw,score", [("0", 0.0), ("1", 0.5), ("2", 1.0), ("3", 0.0), ("x", 0.0), ("2.0", 1.0)])
def test_judge(spark, raw, score):
    assert one(spark, M.judge_score(F.col("t")), t=raw) == score


def test_cosine_of_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [3.0, 4.0])], "z array<float>, a array<float>, b array<float>")
    assert tuple(row.select(M.cosine(F.col("z"), F.col("a")), M.cosine(F.col("a"), F.col("b"))).first()) == (0.0, pytest.approx(0.6))


def test_progress(spark):
    assert one(spark, X.progress(F.lit(1), F.lit(0))) == "1/0 (0.0%)"
    assert one(spark, X.progress(F.lit(1), F.lit(8))) == "1/8 (12.5%)"
