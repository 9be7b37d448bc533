"""HTML to text with the standard library's parser, for markup that expressions don't follow."""

from __future__ import annotations

import html as entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text as X


class _Text(HTMLParser):
    """Text with a line for each row, blanks around cells and a bullet before each list item."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.parts.append({"li": "\n- ", "td": " ", "th": " ", "br": "\n"}.get(tag, ""))

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        self.parts.append({"tr": "\n", "td": " ", "th": " ", "p": "\n", "div": "\n"}.get(tag, ""))

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def to_text(markup: str | None) -> str:
    """The text of a page, with references decoded once more than the parser does; null is ''."""
    parser = _Text()
    parser.feed(markup or "")
    parser.close()
    return entities.unescape("".join(parser.parts))


@F.pandas_udf(StringType())
def _texts(markup: pd.Series) -> pd.Series:
    return markup.map(to_text, na_action="ignore")


def text_of(markup: Column) -> Column:
    """The text of any markup, all references decoded. What has no tag and no reference doesn't go to Python; null is ''."""
    some = markup.rlike("[<&]")
    return F.coalesce(F.when(some, _texts(F.when(some, markup))).otherwise(markup), F.lit(""))


def clean(markup: Column) -> Column:
    """Links, markup, citations and white space, in that order, with the parser for markup; null gives an empty text."""
    return X.normalize_whitespace(X.strip_citations(text_of(X.strip_md_links(markup))))


def parsed_text(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``text``: the column as ``clean`` makes it."""
    return df.withColumn("text", clean(F.col(column)))
