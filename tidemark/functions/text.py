"""Text expressions: cleaning, tokens, chunks and fingerprints. Each takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts tokens.
APART = r"[^\p{L}\p{N}_]+"
#: Takes and returns a text column; puts blanks between the words of a script that has none.
Segmenter = Callable[[Column], Column]


def tokens(text: Column, segment: Segmenter | None = None) -> Column:
    """Lower-cased runs of letters, digits and underscores of at least two characters. Null gives null.

    ``segment`` sees the lower-cased text first; ``han_pairs`` is one, a Pandas UDF over a dictionary another.
    """
    lower = F.lower(text)
    return F.filter(F.split(segment(lower) if segment else lower, APART), lambda t: F.length(t) > 1)


def han_pairs(text: Column) -> Column:
    """A segmenter without a dictionary: neighbouring Han characters stand together in overlapping pairs."""
    apart = F.regexp_replace(text, r"(?<=\p{IsHan})(?=[^\p{IsHan}])|(?<=[^\p{IsHan}])(?=\p{IsHan})", " ")
    return F.regexp_replace(apart, r"(\p{IsHan})(?=(\p{IsHan}))", "$1$2 ")


def strip_md_links(text: Column) -> Column:
    """``[label](target)`` becomes ``label``."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def strip_citations(text: Column) -> Column:
    """``[12]`` goes."""
    return F.regexp_replace(text, r"\[[0-9]+\]", "")


def normalize_whitespace(text: Column) -> Column:
    """Three and more newlines become two, lines are trimmed, runs of blanks and tabs become one blank, the whole is trimmed."""
    fewer = F.regexp_replace(text, r"\n{3,}", "\n\n")
    lines = F.array_join(F.transform(F.split(fewer, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"^[ \n]+|[ \n]+$", "")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


#: Patterns that go from markup, in this order, and what stands in their place.
MARKUP = (
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)</(p|div|tr|h[1-6]|ul|article|nav|footer)>|<br\s*/?>", "\n"),
    (r"(?i)</?(td|th)[^>]*>", " "),
    (r"<[^>]*>", ""),
)


def html_text(html: Column) -> Column:
    """Text of simple markup without a parser: no scripts, styles or tags in either case; rows and blocks end lines.

    The common references are decoded; ``tidemark.functions.html`` decodes all of them and follows any markup.
    """
    out = html
    for pattern, to in MARKUP:
        out = F.regexp_replace(out, pattern, to)
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def clean_html(html: Column) -> Column:
    """Links, markup, citations and white space, in that order; null gives an empty text."""
    return F.coalesce(normalize_whitespace(strip_citations(html_text(strip_md_links(html)))), F.lit(""))


def shrunk(before: Column, after: Column, share: float = 0.1) -> Column:
    """Whether cleaning took more than ``share`` of the characters."""
    return (F.length(before) - F.length(after)) > share * F.length(before)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"[\s]+", " ")), F.lit("")) == ""


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Structs (i, contents) of at most ``size`` blank-separated words, each starting ``size - overlap`` words after the last.

    The last chunk is the first one that reaches the end; an empty text has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step, none = size - overlap, F.array().cast("array<struct<i:int,contents:string>>")

    def made(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / F.lit(step))).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(words, i * step + 1, size), " ").alias("contents")))
        return F.when(F.size(words) > 0, each).otherwise(none)

    # the words are one variable of a lambda, so that the text is split once and not for each chunk
    split = F.array(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.coalesce(F.element_at(F.transform(split, made), 1), none)


def cap(text: Column, size: int = 3000) -> Column:
    """The first ``size`` characters and ``...`` where there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fingerprint(question: Column, answer: Column) -> Column:
    """The first eight hex digits of an MD5 over question and answer."""
    return F.substring(F.md5(F.concat(F.lit("question: "), F.coalesce(question, F.lit("")), F.lit("\nanswer: "), F.coalesce(answer, F.lit("")))), 1, 8)


def numbered_context(texts: Column, label: str = "Document") -> Column:
    """``label 1:\\ntext`` blocks in order, parted by a blank line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), t)), "\n\n")


def progress(done: Column, total: Column) -> Column:
    """``done/total (x.x%)``; a total of zero is 0.0%."""
    share = F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0))
    return F.format_string("%d/%d (%.1f%%)", done, total, share)


def summary_line(name: Column, value: Column, counted: Column | None = None, total: Column | None = None) -> Column:
    """``  name: 0.1234``, and ``(counted/total)`` after it where these are given."""
    line = F.concat(F.lit("  "), name, F.lit(": "), F.format_string("%.4f", value.cast("double")))
    return line if counted is None else F.concat(line, F.format_string(" (%d/%d)", counted, total))


def role_context(description: Column) -> Column:
    """The part of a prompt that asks for a persona's voice; empty without one."""
    return F.when(F.trim(description) != "", F.concat(F.lit("Speak as this person, in their words and with their interests, and name concrete details:\n"), F.trim(description))).otherwise(F.lit(""))


def template_context(template: Column, description: Column, placeholders: Column) -> Column:
    """The part of a prompt that shows a template: example, description if any, placeholders if any; empty without a template."""
    part = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), c))
    names = F.array_join(F.coalesce(placeholders, F.array().cast("array<string>")), ", ")
    shown = F.concat_ws("\n", F.lit("Follow the shape of this template, in other words."), part("Template", template), part("Meaning", description), part("Fill in", names))
    return F.when(F.trim(template) != "", shown).otherwise(F.lit(""))
