"""Entities of chunks, of segments and of question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_capitalized(text: Column) -> Column:
    """Runs of capitalised words of three letters and more, distinct, in first-seen order: an offline stand-in for a model."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,})*)"), F.lit(1)))


def normalize_forms(items: Column) -> Column:
    """Entity variants as JSON texts: all strings stay, all structs give their non-empty ``text``, a mixture gives none."""
    is_struct = F.transform(items, lambda x: x.startswith("{"))
    structs = F.filter(F.transform(items, lambda x: F.get_json_object(x, "$.text")), lambda x: x.isNotNull() & (x != ""))
    return F.when(~F.exists(is_struct, lambda b: b), items).when(F.forall(is_struct, lambda b: b), structs).otherwise(F.array().cast("array<string>"))


def dedup_in_order(items: Column) -> Column:
    """Distinct non-blank entities, trimmed, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def statistics(chunks: DataFrame, entities: str = "entities") -> DataFrame:
    """One row: total chunks and entities (blank ones count), distinct ones (trimmed, lower case), chunks that have any."""
    e = F.coalesce(F.col(entities), F.array().cast("array<string>"))
    totals = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum(F.size(e)), F.lit(0)).cast("long").alias("total_entities"), F.count_if(F.size(e) > 0).alias("chunks_with_entities"))
    unique = chunks.select(F.explode(e).alias("e")).select(F.lower(F.trim("e")).alias("e")).where("e <> ''").agg(F.count_distinct("e").alias("unique_entities"))
    return totals.join(F.broadcast(unique), F.lit(True)).select("total_chunks", "total_entities", "unique_entities", "chunks_with_entities")


def segment_entities(chunks: DataFrame) -> DataFrame:
    """Distinct (segment_id, entity), trimmed, case kept, without the timeless segment."""
    return chunks.where("segment_id > 0").select("segment_id", F.explode("entities").alias("entity")).select("segment_id", F.trim("entity").alias("entity")).where("entity <> ''").distinct()


def discard_overlapping(qa: DataFrame, current: DataFrame, key: str = "qa_id") -> DataFrame:
    """Pairs of ``qa`` (key, entities) none of whose entities is in ``current`` (entity); pairs without entities stay.

    An anti join on the exploded entities, so that neither side is gathered.
    """
    hit = qa.select(key, F.explode("entities").alias("entity")).join(current.select("entity").distinct(), "entity", "left_semi").select(key).distinct()
    return qa.join(hit, key, "left_anti")


def mentions(qa: DataFrame, entities: DataFrame, text: Column, key: str = "qa_id") -> DataFrame:
    """(key, entity) for every entity that the text holds, whatever the case and without word bounds.

    Entities that differ in case only are each found. Null texts and empty entities are in no pair; see ``containment``
    for how texts and entities meet.
    """
    from tidemark.operators.containment import contained

    listed = entities.select("entity").where("entity <> ''").distinct().withColumn("item", F.lower("entity"))
    found = contained(qa.select(F.col(key).alias("id"), F.lower(text).alias("text")), listed)
    return found.join(listed, "item").select(F.col("id").alias(key), "entity").distinct()
