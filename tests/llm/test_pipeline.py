"""The pipeline against its stages done in plain Python, and the queries of the subpackage as registered."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import secrets, toxicity


def _tables(spark, folder):
    rng = random.Random(12)
    stems = "river stone walks green house under the of and with quiet evening light paper".split()
    text = lambda n: " ".join(rng.choice(stems) + str(rng.randrange(40)) for _ in range(n))
    docs, labels = [], []
    for i in range(220):
        t = text(60)
        bad = i % 5 == 0
        docs.append((i, f"{t} moron idiots {text(4)}" if bad else t))
        labels.append((i, 1, int(bad)))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs += [(300 + k, docs[1 + k][1]) for k in range(6) if k != 4]  # copies
    docs += [(320 + k, docs[7][1] + f" end{k}") for k in range(3)]  # near copies
    docs += [(340, text(20) + " " + item), (341, text(2000) + " " + item), (342, item)]
    docs += [(350, text(9) + " password = hunter22 " + text(9)), (351, "token:" + "ab12" * 8 + " " + text(5)), (360, None), (361, ""), (362, "é")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, [(1, item)]


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = _tables(spark, folder)
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    toxic = {r["doc_id"] for r in toxicity.with_predictions(table("documents"), table("labels")).where("predicted = 1").collect()}
    planted = {i for i, t in docs if "moron" in (t or "")}
    assert len(toxic ^ planted) <= 0.02 * len(docs)
    left = [(i, t) for i, t in docs if i not in toxic]
    component = brute.near_duplicates(left)
    left = [(i, t) for i, t in left if component[i][1] == i]
    hit = brute.contamination(left, items)
    left = [(i, t) for i, t in left if not hit[i][-1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left:
        out, at = "", 0
        for _, a, b in secrets.find_spans(t or ""):
            if a >= at:
                out += (t or "")[at:a] + "[secret]"
            at = max(at, b)
        ids = tokenizer.encode(out + (t or "")[at:], add_special_tokens=False).ids
        want[i] = (len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False))
    got = {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert 341 in got and 340 not in got and 342 not in got and 300 not in got and 320 not in got


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    _tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]


def test_registered():
    from tidemark.llm.queries import ORACLES, QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
