"""Projections, filters and gates over question-answer pairs, retrieval results and generation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")


def quality_gate(df: DataFrame, score: Column, least: int = 1) -> DataFrame:
    """Rows whose score is at least ``least``."""
    return df.where(score >= least)


def quality_counts(df: DataFrame, score: Column, least: int = 1) -> DataFrame:
    """One row: total, qualified, discarded."""
    ok = F.coalesce(score >= least, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("qualified"), F.count_if(~ok).alias("discarded"))


def can_refine(question: Column, answer: Column, question_most: int = 250, answer_most: int = 500) -> Column:
    """Whether a pair is short enough to be refined."""
    return (F.length(question) <= question_most) & (F.length(answer) <= answer_most)


def is_valid(question: Column, answer: Column) -> Column:
    """Both are there, and trimmed have at least 5 and 10 characters."""
    return F.coalesce((F.length(F.trim(question)) >= 5) & (F.length(F.trim(answer)) >= 10), F.lit(False))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id, ...): the documents (doc_id, text) that contain an item's text (query_id, item) as it is written.

    Items and texts of any length and number; see ``containment``. Rows on either side that repeat others are rows of
    their own. Null and empty texts and items are in no pair.
    """
    from tidemark.operators.containment import contained

    found = contained(docs.select(F.col("doc_id").alias("id"), "text"), items)
    own = found.join(items.where("item is not null"), "item").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), *items.columns)
    # the hash is a column before the join, so that texts that nobody asks for aren't shuffled
    marked = docs.withColumn("_own", F.xxhash64("text"))
    return marked.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark"))).drop("_id", "_mark", "_own")


def doc_ids(docs: Column, fallback: bool = True) -> Column:
    """Ids of retrieved docs (structs id, metadata): metadata's id, else with ``fallback`` the doc's own; others go."""
    own = F.transform(docs, lambda d: F.coalesce(F.nullif(d["metadata"]["id"], F.lit("")), d["id"]) if fallback else d["metadata"]["id"])
    return F.filter(own, lambda x: x.isNotNull() & (x != ""))


def contexts(given: Column, docs: Column) -> Column:
    """The given contexts, else the contents of the retrieved docs."""
    return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(F.transform(docs, lambda d: d["content"]))


def game_name(original: Column, own: Column, first_doc: Column) -> Column:
    """The pair's game, else the row's, else the first document's, else 'unknown'."""
    return F.coalesce(original, own, first_doc, F.lit("unknown"))


def game_of(result: Column) -> Column:
    """The game of a result as JSON text, by which field is there, not by what it holds.

    ``original_qa_data`` decides even if it has no game, then ``game_name``; without both it is the first
    document whose metadata has a game.
    """
    at = lambda path: F.get_json_object(result, path)
    there = F.coalesce(F.json_object_keys(result), F.array().cast("array<string>"))
    docs = F.from_json(F.coalesce(at("$.retrieved_docs"), F.lit("[]")), "array<struct<metadata:map<string,string>>>")
    games = F.filter(F.transform(docs, lambda d: d["metadata"]["game"]), lambda g: g.isNotNull() & (g != ""))
    found = F.when(F.array_contains(there, "original_qa_data"), at("$.original_qa_data.game_name")).when(F.array_contains(there, "game_name"), at("$.game_name")).otherwise(F.get(games, F.lit(0)))
    return F.coalesce(found, F.lit("unknown"))


def as_pairs(rows: DataFrame) -> DataFrame:
    """(question, ground_truth_answer, ground_truth_docs, ground_truth_doc_ids, original_data) of QA rows; a document without an id has ''."""
    ids = F.transform("retrieved_docs", lambda d: F.coalesce(d["id"], F.lit("")))
    none = F.array().cast("array<string>")
    return rows.select("question", F.col("answer").alias("ground_truth_answer"), F.col("retrieved_docs").alias("ground_truth_docs"), F.coalesce(ids, none).alias("ground_truth_doc_ids"), F.struct(*rows.columns).alias("original_data"))


def validate_pairs(results: DataFrame, truth: DataFrame, fields: tuple[str, ...] = ("question", "answer")) -> list[str]:
    """What stands against an evaluation: an empty side, or a side without one of the fields. Rows share one schema, so that a field is there for all or none."""
    out = []
    for side, df in (("results", results), ("ground truth", truth)):
        missing = [f for f in fields if f not in df.columns]
        out += [f"{side}: no field {f}" for f in missing]
        if not missing and df.isEmpty():
            out.append(f"{side}: no rows")
    return out


def zip_by_order(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """The rows of both sides that have one ordinal (a column of both, unique on each), side by side."""
    return left.join(right, ordinal)


def answer_text(answer: Column, rag_answer: Column) -> Column:
    return F.coalesce(answer, rag_answer, F.lit(""))


def model_key(kind: Column, model: Column, k: Column) -> Column:
    """``bm25_k3`` or ``model_k3``."""
    return F.concat(F.when(kind == "bm25", F.lit("bm25")).otherwise(model), F.lit("_k"), k.cast("string"))


def stamp_inherited(qa: DataFrame, segment: int) -> DataFrame:
    """Pairs of an earlier segment as rows of this one."""
    return qa.withColumns({"segment_id": F.lit(segment), "inherited_from": F.lit(segment - 1), "inheritance_status": F.lit("inherited")})


def select_segment(segments: DataFrame, segment: int) -> DataFrame:
    """The row of a segment above 0; an error if there is none."""
    own = segments.where((F.col("segment_id") > 0) & (F.col("segment_id") == segment))
    if own.isEmpty():
        raise ValueError(f"no segment {segment}")
    return own


def resume(templates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Templates that aren't done yet."""
    return templates.join(done.select(key).distinct(), key, "left_anti")


def status_counts(results: DataFrame) -> DataFrame:
    """(game_name, total, success, errors) by whether ``error`` is null."""
    return results.groupBy("game_name").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def clean_output(qa: DataFrame) -> DataFrame:
    """Entities distinct and in order, inner columns dropped."""
    from tidemark.operators.entities import dedup_in_order

    return qa.withColumn("entities", dedup_in_order(F.col("entities"))).drop("template_id", "source_template", "extracted_entities")


def topic_description(named: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``named`` (topic, ...) with ``description`` from taxonomy (position, main, sub, code, description).

    Tried in this order: a main topic's name (a row without sub), a sub topic's name, a sub topic's code. Main
    codes are never matched; a topic that isn't found describes itself. The taxonomy is configuration.
    """
    keys = taxonomy.where("sub is null").select(F.col("main").alias("topic"), F.lit(0).alias("level"), "position", "description")
    keys = keys.union(taxonomy.where("sub is not null").select("sub", F.lit(1), "position", "description"))
    keys = keys.union(taxonomy.where("sub is not null").select("code", F.lit(2), "position", "description"))
    first = keys.groupBy("topic").agg(F.min_by("description", F.struct("level", "position")).alias("found"))
    return named.join(F.broadcast(first), "topic", "left").withColumn("description", F.coalesce("found", "topic")).drop("found")


#: Turns by number that one window of ``next_answer`` takes at a time.
TURN_BLOCK = 256


def next_answer(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant turn right after it.

    The next turn is looked for within blocks of TURN_BLOCK turns. The last turn of a block meets the first turn
    of the next block there is, so that a long conversation isn't one task.
    """
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.floor(F.col("turn") / TURN_BLOCK).alias("_block"))
    after = Window.partitionBy("conv_id", "_block").orderBy("turn")
    rows = rows.select("*", F.lead("role").over(after).alias("_role"), F.lead("question").over(after).alias("_text"), F.row_number().over(after).alias("_k"), F.lead(F.lit(1)).over(after).isNull().alias("_last"))
    blocks = rows.where("_k = 1").select("conv_id", "_block", F.col("role").alias("_first_role"), F.col("question").alias("_first_text"))
    over = Window.partitionBy("conv_id").orderBy("_block")
    ahead = blocks.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_at"), F.lead("_first_role").over(over).alias("_first_role"), F.lead("_first_text").over(over).alias("_first_text"))
    met = rows.where("_last").join(ahead, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
    own = rows.where("not _last").select("conv_id", "turn", "role", "question", F.col("_role").alias("next_role"), F.col("_text").alias("answer"))
    both = own.union(met.select("conv_id", "turn", "role", "question", "_first_role", "_first_text"))
    return both.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "question", "answer")
