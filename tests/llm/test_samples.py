"""What the models learn from: each text and page once, however often it is there, and as much as the bound takes."""

import pytest

from tidemark.llm import html_extract, language


def test_a_dictionary_has_each_text_once(spark):
    texts = [f"text {chr(97 + i % 26)}{i} " * 40 for i in range(30)]
    rows = [(t, "aa") for t in texts] + [("copied over and over", "aa")] * 2000
    content = dict(language.fit(spark.createDataFrame(rows, "text string, lang string")))["aa"].decode()
    assert content.count("copied over and over") == 1
    assert sum(f" {t.split()[1]} " in content for t in texts) == 30


def test_a_dictionary_is_filled(spark):
    rows = [(f"wort{i} " * 200, "aa") for i in range(400)]
    assert len(dict(language.fit(spark.createDataFrame(rows, "text string, lang string")))["aa"]) > language.DICT_BYTES - language.ROW_CHARS


def test_a_page_is_learned_from_once(spark):
    rows = [("<article><p>copied</p></article>",)] * 500 + [(f"<article><p>page {i}</p></article>",) for i in range(150)]
    got = [r["html"] for r in html_extract.sample(spark.createDataFrame(rows, "html string")).collect()]
    assert sorted(got) == sorted({h for (h,) in rows})


@pytest.mark.parametrize(
    "html,texts",
    [
        ("<p>a<svg viewBox='0 0 1 1'/>b</p><p>c</p>", ["ab", "c"]),
        ("<p>a<svg><text>no</text></svg>b</p>", ["ab"]),
        ("<p>a</p><option value=1><p>b</p>", ["a", "b"]),
        ("<datalist><option>no<option>no</datalist><p>a</p>", ["a"]),
        ("<option>x<p>a</p><option>no</option><p>b</p>", ["x", "a", "b"]),
        ("<button><p>a</p><button>no</button><object><p>b</p>", ["a", "b"]),
        ("<head><title>no</title><body><p>a</p>", ["a"]),
        ("<head><meta charset=x><p>a</p><p>b</p>", ["a", "b"]),
        ("<head><title>no</title>a<p>b</p>", ["a", "b"]),
    ],
)
def test_only_hidden_elements_are_dropped(html, texts):
    assert [t for _, t, _ in html_extract.blocks(html)] == texts
