"""Expressions that take answers of language models apart. Each is a ladder: the first step that gives something wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_body(text: Column) -> Column:
    """The JSON in an answer: in ``<json>`` tags, in a json fence, in any fence if it has braces, between the outermost braces, or ''.

    Tags and json fences decide even if there is nothing in them.
    """
    within = lambda pattern: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    tagged = within(r"(?s)<json>\s*(.*?)\s*</json>")
    fenced = within(r"(?s)```json\s*(.*?)\s*```")
    plain = _found(text, r"(?s)```[a-zA-Z]*\s*(\{.*?\})\s*```")
    braces = _found(text, r"(?s)(\{.*\})")
    return F.coalesce(tagged, fenced, plain, braces, F.lit(""))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def repair_truncated(text: Column) -> Column:
    """Close what an answer that ends with ``...``, white space aside, has left open: a quote, then braces, then brackets. Others stay."""

    def quoted(base: Column) -> Column:
        return F.concat(base, F.when(_count(base, '"') % 2 == 1, F.lit('"')).otherwise(F.lit("")))

    def closed(own: Column) -> Column:
        braces = F.greatest(F.lit(0), _count(own, "{") - _count(own, "}"))
        brackets = F.greatest(F.lit(0), _count(own, "[") - _count(own, "]"))
        return F.concat(own, F.repeat(F.lit("}"), braces), F.repeat(F.lit("]"), brackets))

    cut = lambda t: _let(_let(F.regexp_replace(t, r"\.\.\.\s*$", ""), quoted), closed)
    return _let(text, lambda t: F.when(t.rlike(r"\.\.\.\s*$"), cut(t)).otherwise(t))


def hypothetical(response: Column, template: Column) -> Column:
    """Struct (question, answer) from the last prefixed lines, else first line and rest, else template and response."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.trim(x))

    def last(prefix: str) -> Column:
        own = F.filter(lines, lambda x: x.rlike(f"^(?i){prefix}[:：]"))
        return F.when(F.size(own) > 0, F.trim(F.regexp_replace(F.element_at(own, -1), f"^(?i){prefix}[:：]", "")))

    q, a = last("question"), last("answer")
    some = F.filter(lines, lambda x: x != "")
    first = F.when(F.size(some) > 1, F.element_at(some, 1))
    rest = F.when(F.size(some) > 1, F.array_join(F.slice(some, 2, 1_000_000), "\n"))
    both = q.isNotNull() & a.isNotNull()
    return F.struct(
        F.when(both, q).otherwise(F.coalesce(first, template)).alias("question"),
        F.when(both, a).otherwise(F.coalesce(rest, response)).alias("answer"),
    )


#: Openings that an answer may have and that are cut once, in this order.
PREFIXES = ("answer:", "response:", "the answer is", "based on the context,")


def strip_prefixes(response: Column) -> Column:
    """One blank for any white space, trimmed; then each known opening is cut, one after the other."""
    out = F.trim(F.regexp_replace(response, r"\s+", " "))
    for p in PREFIXES:
        out = F.when(F.lower(out).startswith(p), F.trim(F.substring(out, len(p) + 1, 1_000_000))).otherwise(out)
    return out


def strip_fence(text: Column) -> Column:
    """The text without a fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def entity_list(text: Column) -> Column:
    """``entities`` of an answer: the whole as JSON, a fence, the braces, a bare list, or empty."""
    kind = "struct<entities:array<struct<text:string,type:string,context:string>>>"
    whole = F.from_json(text, kind)
    body = F.from_json(json_body(text), kind)
    bare = F.from_json(F.concat(F.lit("{"), _found(text, r'(?s)("entities"\s*:\s*\[.*?\])'), F.lit("}")), kind)
    return F.coalesce(whole["entities"], body["entities"], bare["entities"], F.array().cast("array<struct<text:string,type:string,context:string>>"))


def qa_record(text: Column) -> Column:
    """Struct (question, answer, method) by three methods: JSON, labelled lines, or a line that ends with a question mark."""
    kind = "struct<question:string,answer:string>"
    js = F.from_json(repair_truncated(json_body(text)), kind)
    q = _found(text, r"(?im)^\s*(?:q|question)\s*[:：]\s*(.+)$")
    a = _found(text, r"(?im)^\s*(?:a|answer)\s*[:：]\s*(.+)$")
    hq = _found(text, r"(?m)^\s*(.*\?)\s*$")
    ha = _found(text, r"(?ms)^\s*.*?\?\s*\n\s*(.+)$")

    def record(v: Column) -> Column:
        ok = v["js"]["question"].isNotNull() & v["js"]["answer"].isNotNull()
        lines = v["q"].isNotNull() & v["a"].isNotNull()
        return F.struct(
            F.when(ok, v["js"]["question"]).when(lines, v["q"]).otherwise(v["hq"]).alias("question"),
            F.when(ok, v["js"]["answer"]).when(lines, v["a"]).otherwise(v["ha"]).alias("answer"),
            F.when(ok, "json").when(lines, "lines").when(v["hq"].isNotNull(), "heuristic").otherwise("none").alias("method"),
        )

    return _let(F.struct(js.alias("js"), q.alias("q"), a.alias("a"), hq.alias("hq"), ha.alias("ha")), record)


def template_record(text: Column) -> Column:
    """Struct (template, description, method): JSON, else labelled line, else the whole text as the template."""
    js = F.from_json(repair_truncated(json_body(text)), "struct<template:string,description:string>")
    line = _found(text, r"(?im)^\s*template\s*[:：]\s*(.+)$")

    def record(v: Column) -> Column:
        method = F.when(v["js"]["template"].isNotNull(), "json").when(v["line"].isNotNull(), "lines").otherwise("fallback")
        return F.struct(F.coalesce(v["js"]["template"], v["line"], F.trim(v["text"])).alias("template"), v["js"]["description"].alias("description"), method.alias("method"))

    return _let(F.struct(js.alias("js"), line.alias("line"), text.alias("text")), record)


def template_list(text: Column) -> Column:
    """Structs (template, placeholders, description, method) of an answer that isn't what was asked for.

    Tried in this order: ``templates`` of the JSON between the outermost braces, with a cut end repaired
    (method ``templates``; it decides even if the list is empty or missing, as long as the JSON can be read);
    the whole answer without its fence as one question and answer (``pair``); the first ``"question": "..."``
    anywhere (``pattern``); else none.
    """
    kind = "struct<template:string,placeholders:array<string>,description:string>"
    none = F.array().cast("array<string>")
    made = lambda t, p, d, m: F.struct(F.coalesce(t, F.lit("")).alias("template"), F.coalesce(p, none).alias("placeholders"), F.coalesce(d, F.lit("")).alias("description"), F.lit(m).alias("method"))
    body = repair_truncated(F.coalesce(_found(text, r"(?s)(\{.*\})"), F.lit("")))
    pair = F.from_json(repair_truncated(strip_fence(text)), "struct<question:string,answer:string,placeholders:array<string>,description:string>")

    def listed(v: Column) -> Column:
        first = F.transform(F.coalesce(v["list"]["templates"], F.array().cast(f"array<{kind}>")), lambda x: made(x["template"], x["placeholders"], x["description"], "templates"))
        second = F.array(made(v["pair"]["question"], v["pair"]["placeholders"], v["pair"]["description"], "pair"))
        third = F.array(made(v["found"], none, F.lit(""), "pattern"))
        nothing = F.slice(F.array(made(F.lit(""), none, F.lit(""), "none")), 1, 0)
        return F.when(v["readable"], first).when(v["pair"]["question"].isNotNull() & v["pair"]["answer"].isNotNull(), second).when(v["found"].isNotNull(), third).otherwise(nothing)

    parts = _let(body, lambda b: F.struct(F.from_json(b, f"struct<templates:array<{kind}>>").alias("list"), F.try_parse_json(b).isNotNull().alias("readable")))
    found = _found(text, r'"question":\s*"([^"]+)"')
    return _let(F.struct(parts["list"].alias("list"), parts["readable"].alias("readable"), pair.alias("pair"), found.alias("found")), listed)
