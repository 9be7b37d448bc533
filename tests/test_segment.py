"""Segmentation by a lexicon against a search over all paths, and its use in retrieval."""

import math
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import segment as S
from tidemark.functions.text import tokens
from tidemark.operators import bm25

HAN = "天地玄黄宇宙洪荒日月盈昃"


def plain(run, words):
    """The best path from the end: larger weight, then the longer word."""
    total = math.log(max(1, sum(words.values())))
    best = [(0.0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        best[i] = max((math.log(words.get(run[i:j], 1)) - total + best[j][0], j) for j in range(i + 1, len(run) + 1) if j == i + 1 or words.get(run[i:j], 0) > 0)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : best[i][1]])
        i = best[i][1]
    return out


def weight(path, words):
    total = math.log(max(1, sum(words.values())))
    return sum(math.log(words.get(w, 1)) - total for w in path)


def test_the_path_is_the_best_of_all(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice(HAN) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 900) for _ in range(120)}
    texts = ["".join(rng.choice(HAN) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    lexicon = spark.createDataFrame([*words.items(), (None, 3), ("坏", 0), ("坏" * 30, 9)], "word string, freq long")
    cut = S.segmenter(lexicon)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for r in rows.select("t", cut(F.col("t")).alias("s")).collect():
        got, want = r["s"].split(), plain(r["t"], words)
        assert "".join(got) == r["t"]
        assert math.isclose(weight(got, words), weight(want, words), abs_tol=1e-9)


def test_other_scripts_blanks_and_nulls_stay(spark):
    lexicon = spark.createDataFrame([("天地", 50), ("宇宙", 40), ("天", 3)], "word string, freq long")
    cut = S.segmenter(lexicon)
    texts = ["天地ab宇宙 cd, 宇宙。天x", "plain text", "", None, "宇" + "天地" * 50_000, "𠀀天地\n宇宙"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(cut(F.col("t"))).collect()]
    assert [None if g is None else g.split() for g in got[:4]] == [["天地", "ab", "宇宙", "cd,", "宇宙", "。", "天", "x"], ["plain", "text"], [], None]
    assert got[4].split() == ["宇"] + ["天地"] * 50_000 and got[5].split() == ["𠀀", "天地", "宇宙"]
    none = S.segmenter(lexicon.limit(0))
    assert spark.range(1).select(none(F.lit("天地a"))).first()[0].split() == ["天", "地", "a"]


def test_retrieval_by_words(spark):
    lexicon = spark.createDataFrame([("天地", 50), ("地玄", 9), ("玄黄", 40), ("宇宙", 40), ("洪荒", 30)], "word string, freq long")
    docs = spark.createDataFrame([(1, "天地玄黄"), (2, "宇宙洪荒 and more"), (3, "more天地")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "玄黄"), (2, "地玄"), (3, "宇宙 more")], "query_id long, text string")
    cut = S.segmenter(lexicon)
    assert docs.select(tokens(F.col("text"), cut).alias("t")).collect() == [(["天地", "玄黄"],), (["宇宙", "洪荒", "and", "more"],), (["more", "天地"],)]
    got = {(r["query_id"], r["doc_id"]) for r in bm25.retrieve(docs, asked, 3, segment=cut).collect()}
    assert got == {(1, 1), (3, 2), (3, 3)}  # characters across two words are no word of a text


def test_a_lexicon_is_learned(spark):
    rng = random.Random(2)
    known = ["天地", "玄黄", "宇宙洪", "日月", "盈昃", "荒"]
    texts = [("".join(rng.choice(known) for _ in range(30)) + "。ab",) for _ in range(200)]
    found = {r["word"]: r["freq"] for r in S.learn(spark.createDataFrame(texts, "text string"), cohesion=4.0).collect()}
    joined = "".join(t for t, in texts)
    assert {"天地", "玄黄", "宇宙洪", "日月", "盈昃"} <= set(found) and found["荒"] == joined.count("荒")
    assert not [w for w in found if len(w) == 2 and not any(w in k for k in known)]
    assert all(re.fullmatch(r"\w+", w) and not w.isascii() for w in found)
    cut = S.segmenter(spark.createDataFrame([*found.items()], "word string, freq long"))
    assert spark.range(1).select(cut(F.lit("日月天地荒"))).first()[0].split() == ["日月", "天地", "荒"]


def test_long_pieces_cost_what_short_ones_do():
    import time

    lexicon = S.Lexicon({"天" * k: 40 - k for k in range(1, 13)} | {"地天": 3})

    def seconds(texts):
        began = time.perf_counter()
        out = lexicon.spaced(texts)
        return time.perf_counter() - began, out

    seconds(["天" * 10])
    short, _ = seconds(["天" * 10] * 12_000)
    long, out = seconds(["天" * 120_000])  # no cut: each of its places was a round of all lengths
    assert out[0].split() == ["天" * 12] * 10_000 and long < 30 * max(short, 0.05)


def test_paths_are_the_same_together_and_one_by_one(monkeypatch):
    rng = random.Random(3)
    words = {"".join(rng.choice(HAN[:3]) for _ in range(rng.randrange(1, 13))): rng.randrange(1, 50) for _ in range(60)}
    lexicon, texts = S.Lexicon(words), ["".join(rng.choice(HAN[:4]) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    want = [[w for w in plain(t, words)] for t in texts]
    for few in (1, 20, 10**6):
        monkeypatch.setattr(S, "_FEW", few)
        for got, w, t in zip(lexicon.spaced(texts), want, texts):
            assert "".join(got.split()) == t and math.isclose(weight(got.split(), words), weight(w, words), abs_tol=1e-6)
