"""Models against plain versions of themselves, and inputs at the edges: copies, clashing columns, very long rows, empty tables."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_contracts import LANGUAGES, _page, _toxic, by_id, frame, words
from tidemark.llm import bpe, decontamination, html_extract, language, near_dedup, secrets, substring_dedup, toxicity

EMPTY = "doc_id long, text string"


def test_ftrl_is_the_plain_one():
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 60, rng.integers(1, 15)).astype(np.uint64) for _ in range(200)]
    labels = np.array([float(3 in r.tolist() or 9 in r.tolist()) for r in rows])
    bias, coordinates, w = toxicity.ftrl(rows, labels, 3, 0.5, 1.0, 0.4, 0.1)
    want_bias, want = brute.ftrl([r.tolist() for r in rows], labels, 3, 0.5, 1.0, 0.4, 0.1)
    assert bias == pytest.approx(want_bias)
    assert dict(zip(coordinates.tolist(), w.tolist())) == pytest.approx({k: v for k, v in want.items() if abs(v) >= toxicity.MIN_WEIGHT})


def test_toxicity_of_copies_long_texts_and_clashing_columns(spark):
    rows = _toxic(random.Random(8), 400)
    copied = [(1, "trash idiots " + "w" * 9)] * 300  # one labelled id, again and again
    long = (5000, "mild words only " * 60_000)
    kind = "doc_id long, text string, score string, predicted string, held_out string, at string, toxic string"
    docs = spark.createDataFrame([(i, t, *"abcde") for i, t in [*((i, t) for i, t, _ in rows if i != 1), *copied, long, (None, None), (5001, "")]], kind).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels).count() <= len(rows) + 1
    assert toxicity.sample(docs, labels).where("text like 'mild%'").count() == 0
    found = toxicity.with_predictions(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    assert {r["predicted"] for r in found.where("doc_id = 5000").collect()} == {0}
    kept = toxicity.remove_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"a"}
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 1").count() == 0


def test_language_is_the_plain_compression(spark):
    rng = random.Random(3)
    model = [(lang, " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(5)) for _ in range(400)).encode()) for lang in LANGUAGES]
    texts = [" ".join("".join(rng.choice(LANGUAGES[rng.choice(sorted(LANGUAGES))]) for _ in range(4)) for _ in range(n)) for n in (1, 3, 20, 200, 2000, 9000)]
    rows = [*enumerate(texts), (90, None), (91, "!! 12"), (92, texts[2]), (92, texts[2])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, lang_pred string")
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "accepted"] and got.count() == len(rows)
    assert all(r["lang_pred"] == brute.language(r["text"], model, language.PIECE, language.LEVEL) for r in got.collect())


def test_a_language_of_one_text_is_learned(spark):
    rng = random.Random(4)
    alone = "".join(rng.choice("zvrstqhd ") for _ in range(300))
    stems = ["".join(rng.choice("takolemi") for _ in range(5)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(30)), "aa") for i in range(200)] + [(1000 + i, alone, "bb") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = language.with_predictions(docs).withColumn("own", (F.col("doc_id") >= 1000))
    assert {(r["own"], r["lang_pred"]) for r in found.select("own", "lang_pred").distinct().collect()} == {(False, "aa"), (True, "bb")}


def test_one_page_many_times(spark):
    html, text = _page(1, random.Random(6))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(html).alias("html")).repartition(4)
    network = html_extract.fit(pages)
    assert network is not None
    assert [r["text"] for r in html_extract.extract(pages, network).select("text").distinct().collect()] == [text]


def test_pages_without_a_telling_tag(spark):
    """The labeller learns from pages with an article tag; these have bare containers, and main text is what isn't menu or footer."""
    rng = random.Random(15)
    learned = [_page(k, rng)[0] for k in range(80)]
    right = n = 0
    network = html_extract.train_on(learned)
    for k in range(20):
        main = [" ".join(words(rng, rng.randrange(20, 60))) + "." for _ in range(rng.randrange(3, 7))]
        menu = [f"<li><a href='/{i}'>{rng.choice('home news about more'.split())}</a></li>" for i in range(5)]
        html = f"<body><ul>{''.join(menu)}</ul><div>{''.join(f'<p>{m}</p>' for m in main)}</div><div><a href='/x'>imprint</a></div></body>"
        page = html_extract.blocks(html)
        for (_, text, linked), p in zip(page, network.label([page])[0]):
            n += 1
            right += (p >= 0.5) == (linked < len(text))
    assert right >= 0.9 * n


@pytest.mark.parametrize(
    "html,texts",
    [
        ("<p>a<svg viewBox='0'/>b</p><p>c</p>", ["ab", "c"]),
        ("<script a=\"b>var x = '</p>';</script><p>t</p>", ["t"]),
        ("<script src=x'y>code()</script>t", ["t"]),
        ("<select><option>1<option>2</select><p>t", ["t"]),
        ("<p>a</p><option>lone<p>b", ["a", "lone", "b"]),
        ("<head><title>x</title><p>t</p>", ["t"]),
    ],
)
def test_blocks_at_the_edges(html, texts):
    assert [t for _, t, _ in html_extract.blocks(html)] == texts


def test_a_long_page_is_labelled_as_a_whole():
    rng = random.Random(9)
    network = html_extract.train_on([_page(k, rng)[0] for k in range(20)])
    page = html_extract.blocks("".join(f"<p>{' '.join(words(rng, 4))}</p>" for _ in range(3000)))
    x, mask = html_extract.padded([html_extract.vectors(page)])
    assert np.allclose(network.probabilities(x, mask)[:, 0], network.long_page(page, 500), atol=1e-5)
    many = [(html_extract.Path(None, ("p",)), "a b", 0)] * 200_000
    assert len(network.label([many, page])[0]) == 200_000


def test_bpe_of_copies_and_clashing_columns(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two", "x", "y")] * 3 + [(None, None, "x", "y")], "doc_id long, text string, ids string, decoded string")
    out = bpe.round_trip(docs, path)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in out.collect()) == [(0, ""), *[(1, "one</w> two</w>")] * 3]
    assert bpe.decode(bpe.encode(docs, path), path).where("decoded = 'one</w> two</w>'").count() == 3
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(none, path).first()["decoded"] is None


def test_secrets_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, blob string, c0 string, hint string")
    assert secrets.scan(docs).count() == 0 and secrets.redact(docs).columns == docs.columns
    one = spark.createDataFrame([(1, "token: abcdefgh", "b", "c", "h")], docs.schema)
    assert [tuple(r) for r in secrets.redact(one).collect()] == [(1, "[secret]", "b", "c", "h")]


def test_spans_of_a_benchmark_are_removed(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = [(1, f"Before, {item} after {item}!"), (2, "nothing"), (None, item), (3, None)]
    got = {r["doc_id"]: (r["text"], r["n_hit"], r["n_words"]) for r in decontamination.remove_spans(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: ("before after", 28, 30), None: ("", 14, 14)}


def test_pipeline_keeps_columns_named_like_a_stage_s_own(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, " ".join(words(random.Random(i), 40)) + (" vile scum" if i % 4 == 0 else ""), "en", "s", 9, f"s{i}", "p", "h", "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, held_out string, blob string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes and all(r["score"] == f"s{r['doc_id']}" for r in out.collect())


def test_long_rows_and_null_ids(spark):
    """Texts of millions of characters, and rows without an id, through the operators on word sequences."""
    rng = random.Random(11)
    passage = " ".join(words(rng, 60))
    long = " ".join(words(rng, 200_000))
    docs = spark.createDataFrame([(1, long + " " + passage), (2, passage), (None, passage), (3, "x" * 2_000_000)], EMPTY)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_passages(docs).collect()}
    assert got == {1: 0, 2: 60, None: 0, 3: 0}
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, None: None, 3: 3}


def test_every_letter_but_a_to_z_keeps_its_case(spark):
    """Each character of Unicode in a text of its own, beside an item that has the same one and an item with its lower case."""
    chars = [chr(c) for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    docs = [(k, f"One {c}x two É") for k, c in enumerate(chars)]
    items = [(k, f"oNE {c}X TWO É") for k, c in enumerate(chars)] + [(100_000 + k, f"one {c.lower()}x two é") for k, c in enumerate(chars)]
    found = decontamination.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()}
    want = {i: v[:3] for i, v in brute.contamination(docs, items).items()}
    assert got == want and len(want) > 1300


def test_contaminated_rows_go_whatever_their_columns(spark):
    item = "alpha beta gamma"
    docs = spark.createDataFrame([(1, item, 1, 2, "a", "b"), (2, "clean", 1, 2, "a", "b"), (None, item, 1, 2, "a", "b")], "doc_id long, text string, _bad_id long, _bad_key long, id string, key string")
    kept = decontamination.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


@pytest.mark.parametrize("text", ["eyJ" * 3_500_000, "-----BEGIN PRIVATE KEY-----\nabc\n" * 300_000, "-----BEGIN PRIVATE KEY-----" + "a" * 10_000_000, "eyJabcdefgh." * 900_000, "password " * 1_200_000, "-" * 10_000_000])
def test_long_texts_are_scanned_once(text):
    began = time.time()
    secrets.find_spans(text)
    assert time.time() - began < 30


def test_added_rules_find_what_they_are_for():
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4\nAB+/=\n-----END RSA PRIVATE KEY-----"
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    text = f"-----BEGIN PRIVATE KEY-----\n{key} and {token}, {token}"
    kinds = [(k, text[a:b]) for k, a, b in secrets.find_spans(text)]
    assert kinds == [("private_key", key), ("web_token", token), ("web_token", token)]


class _Leaves(HTMLParser):
    """Leaf blocks of well-formed pages, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts, self.found = 0, [], []

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in html_extract.HIDDEN_TAGS
        if tag not in html_extract.INLINE:
            self.cut()
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in html_extract.HIDDEN_TAGS
        if tag not in html_extract.INLINE:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_extraction_is_the_plain_one(spark):
    """Every page by itself, its blocks by the standard parser, its labels from one run of the network over it."""
    rng = random.Random(21)
    htmls = [_page(k, rng)[0] for k in range(60)]
    htmls += [h.replace("<p>", "<p><b>R&amp;D &eacute;</b>&nbsp;<br> ", 1) for h in htmls[:10]]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(htmls)], "page_id long, url string, html string").repartition(3)
    network = html_extract.fit(pages)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, network).collect()}
    for k, html in enumerate(htmls):
        plain = _Leaves()
        plain.feed(html)
        plain.cut()
        page = html_extract.blocks(html)
        assert [t for _, t, _ in page] == plain.found
        x, mask = html_extract.padded([html_extract.vectors(page)])
        assert got[k] == "\n".join(t for t, p in zip(plain.found, network.probabilities(x, mask)[:, 0]) if p >= 0.5)


def test_tables_of_odd_pages_give_text(spark):
    """Only long pages; only pages without a telling tag; a page of elements that never close."""
    rng = random.Random(22)
    long = [(k, "u", _page(k, rng)[0].replace("</article>", f"<p>{' '.join(words(rng, 9000))}.</p></article>")) for k in range(12)]
    assert all(len(h) > html_extract.MAX_PAGE_CHARS // 2 for _, _, h in long)
    schema = "page_id long, url string, html string"
    for rows, bound in ((long, 3000), ([(1, "u", "<div><p>Plain words of a page.</p><ul><li><a href='/'>home</a></li></ul></div>")], 65_536)):
        pages = spark.createDataFrame(rows, schema)
        html_extract.MAX_PAGE_CHARS, before = bound, html_extract.MAX_PAGE_CHARS
        try:
            network = html_extract.fit(pages)
        finally:
            html_extract.MAX_PAGE_CHARS = before
        texts = [r["text"] for r in html_extract.extract(pages, network).collect()]
        assert all(texts) and not any("home" in t.split("\n") for t in texts[:1])


def test_deep_pages_take_no_square():
    began = time.time()
    page = html_extract.blocks("".join(f"<div class='a{k % 7}'>w{k}" for k in range(100_000)) + "</p>" * 100_000 + "</div>" * 100_000)
    assert len(page) == 100_000 and page[-1][0].length == 200_000
    html_extract.vectors(page, 0, 4096)
    assert len(html_extract.blocks("<b>x" * 100_000 + "</i>" * 100_000)) == 1
    assert time.time() - began < 30


def test_more_languages_than_tasks_hold(spark, monkeypatch):
    """A thousand languages in shards: the sizes of all of them decide, as with one shard."""
    rng = random.Random(31)
    stems = {f"l{k:04d}": ["".join(chr(0x4E00 + k * 9 + rng.randrange(9)) for _ in range(5)) for _ in range(6)] for k in range(1000)}
    rows = [(1000 * r + k, " ".join(rng.choice(w) for _ in range(12)), lang, "x") for r in range(2) for k, (lang, w) in enumerate(stems.items())]
    docs = spark.createDataFrame([*rows, (9001, None, "l0001", "x"), (9002, "12", None, "x")], "doc_id long, text string, lang string, best string").repartition(4)
    model = language.fit(docs)
    assert isinstance(model, language.Shards) and model.n == 1000
    whole = [x for shard in model for x in shard]
    assert len(whole) == 1000 and len({lang for lang, _ in whole}) == 1000
    some = docs.where("doc_id % 25 = 0 or doc_id > 9000")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in language.identify(some, model).collect()}
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2000)
    at_once = language.identify(some, whole)
    assert at_once.columns == ["doc_id", "text", "lang", "best", "lang_pred", "score", "accepted"]
    assert got == {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in at_once.collect()}
    assert got[9001] == got[9002] == ("und", 0.0, False)
    right = [r for r in rows if r[0] % 25 == 0 and got[r[0]][0] == r[2]]
    assert len(right) >= 0.9 * len([r for r in rows if r[0] % 25 == 0])


def test_more_links_are_followed_between_components_only(spark, monkeypatch):
    """What later rounds of near-duplicates do: the links of a round aren't all gone through again."""
    from tidemark.llm import _graph

    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(k, k + 1) for k in range(0, 90) if k % 10 != 9] + [(5, 3)]
    more = [(7, 12), (19, 29), (35, 200), (201, 202), (15, 3), (88, 81)]
    found = _graph.materialize(_graph.components(pairs(first), by_stars=True), "components")
    sizes, write = [], _graph.materialize
    monkeypatch.setattr(_graph, "materialize", lambda df, name: sizes.append((name, (out := write(df, name)).count())) or out)
    got = sorted(map(tuple, _graph.merged(found, pairs(more)).collect()))
    assert got == sorted(map(tuple, _graph.components(pairs(first + more)).collect()))
    assert next(n for name, n in sizes if name == "edges") == 4  # of 88 links and more
