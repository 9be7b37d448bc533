"""Source files to chunks by segment, as one plan for all segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import entity_list
from tidemark.functions.html import clean
from tidemark.functions.text import chunks
from tidemark.operators.entities import dedup_in_order, extract_capitalized
from tidemark.operators.qa import drop_blank
from tidemark.operators.temporal import assign_segments, with_time_metadata
from tidemark.plans import prompts as T
from tidemark.plans.providers import Provider, asked, call


def build_corpus(files: DataFrame, segments: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, title, contents, segment_id, entities, extracted_date) from files (file_path, title, text).

    Cleaning, dates, segments, chunks and entities are expressions over one row at a time: the plan has no
    shuffle, and each file meets its segment without the files being grouped.
    """
    rows = drop_blank(files.withColumn("text", clean(F.col("text"))))
    rows = assign_segments(with_time_metadata(rows), F.col("extracted_date").try_cast("date"), segments)
    path = F.substring(F.md5(F.coalesce("file_path", "title")), 1, 8)  # files of one name in two folders are two
    rows = rows.select("title", path.alias("path"), "segment_id", "extracted_date", F.explode(chunks(F.col("text"), size, overlap)).alias("c"))
    return rows.select(
        F.concat_ws("#", "title", "path", F.col("c.i").cast("string")).alias("id"),
        "title",
        F.col("c.contents").alias("contents"),
        "segment_id",
        extract_capitalized(F.col("c.contents")).alias("entities"),
        "extracted_date",
    )


def _names(reply: Column) -> Column:
    return dedup_in_order(F.transform(entity_list(F.coalesce(reply, F.lit(""))), lambda e: e["text"]))


def extract_entities(chunks: DataFrame, provider: Provider) -> DataFrame:
    """``chunks`` with entities from a model's replies about the whole contents.

    Three steps: the model first writes examples for a text like this one, then entities for the examples, and
    these stand before the text in the third prompt. Where the first two give nothing, or the third no
    entities, the text is sent by itself; a reply without any gives an empty list. Replies are read by the
    ladder of ``entity_list``; texts are distinct and in order of mention.
    """
    kind = "struct<shown:boolean,reply:string>"
    text = F.coalesce("contents", F.lit(""))
    rows = call(chunks.drop("entities").withColumn("_p", text), "_p", "_first", kind, _in_steps(provider), fallback=None, tries=1)
    rows = rows.withColumn("entities", _names(F.col("_first.reply")))
    none = (F.size("entities") == 0) & F.col("_first.shown")
    direct = F.concat(F.lit(T.ENTITIES + "\n"), text)
    again = call(rows.withColumn("_p", F.when(none, direct).otherwise(F.lit(""))), "_p", "_reply_again", "string", _only_asked(provider), fallback="")
    return again.withColumn("entities", F.when(none, _names(F.col("_reply_again"))).otherwise(F.col("entities"))).select(*chunks.columns)


def _in_steps(provider: Provider) -> Provider:
    """(shown, reply) for texts: examples, entities of the examples, then the text behind both if they are there.

    One worker asks all three, so that a text passes through Python once and not once a step.
    """

    def ask(texts: list[str]) -> list[tuple[bool, str]]:
        replies = lambda prompts: ["" if error or r is None else r for r, error in asked(provider, prompts)]
        examples = replies([f"{T.EXAMPLES}\n{t}" for t in texts])
        shown = replies([f"{T.ENTITIES_OF_EXAMPLES}\n{e}" for e in examples])
        some = [bool(e.strip(" ")) and bool(s.strip(" ")) for e, s in zip(examples, shown)]
        direct = [f"{T.ENTITIES}\n{t}" for t in texts]
        last = replies([f"Examples:\n{e}\n{s}\n\n{d}" if x else d for e, s, d, x in zip(examples, shown, direct, some)])
        return list(zip(some, last))

    return ask


def _only_asked(provider: Provider) -> Provider:
    """The provider for the prompts that aren't empty."""

    def ask(prompts: list[str]) -> list:
        asked = [p for p in prompts if p]
        replies = iter(provider(asked) if asked else [])
        return [next(replies) if p else "" for p in prompts]

    return ask
