"""Question-answer pairs for a segment: what is inherited, what is drawn, and what the providers make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import hypothetical, qa_record, strip_fence, strip_prefixes
from tidemark.functions.text import numbered_context, role_context, template_context
from tidemark.operators import allocation as L
from tidemark.operators import bm25, vector
from tidemark.operators.entities import dedup_in_order, discard_overlapping, extract_capitalized, mentions
from tidemark.operators.nearest import nearest
from tidemark.operators.qa import can_refine, is_valid, quality_gate, resume, stamp_inherited
from tidemark.operators.temporal import latest_date
from tidemark.plans.config import GenerationConfig
from tidemark.plans.prompts import REFINE
from tidemark.plans.providers import Provider, call, embed, offline_answer, offline_embedding, offline_judge, offline_question


def inherit(previous: DataFrame, entities: DataFrame, types: DataFrame, n: int, segment: int) -> DataFrame:
    """The pairs of the previous segment that this one inherits.

    ``previous`` (qa_id, question_topic, entities, ...), ``entities`` (entity) of this segment, ``types`` (topic, n).
    Pairs that share an entity go; of the others each topic gives up to its target.
    """
    candidates = discard_overlapping(previous, entities).withColumn("topic", F.coalesce("question_topic", F.lit("UNKNOWN")))
    available = candidates.groupBy("topic").agg(F.count("*").alias("available"))
    plan = L.inherit_plan(L.inherit_targets(types, n), available)
    quota = plan.select("topic", F.col("inherit").alias("allocated"))
    return stamp_inherited(L.stratified_sample(candidates, quota, "qa_id").drop("topic"), segment)


def matched_personas(templates: DataFrame, personas: DataFrame, vectors: Provider, least: float = 0.6) -> DataFrame:
    """``templates`` (id, template, topic, ...) with ``role_data``: the persona nearest to each, null where none is as near as ``least``.

    ``personas`` has (persona_id, player_description, source_content, source_topic).
    """
    own = lambda c: F.col(c) if c in templates.columns else F.lit(None).cast("string")
    t = templates.select(F.col("id").alias("query_id"), vector.template_text(own("template"), own("question_topic"), own("description"), own("topic")).alias("text"))
    p = personas.select(F.col("persona_id").alias("vec_id"), vector.persona_text(F.col("player_description"), F.col("source_content"), F.col("source_topic")).alias("text"))
    best = vector.best_match(nearest(embed(t, "text", "embedding", vectors), embed(p, "text", "embedding", vectors), 1), least)
    role = F.struct(F.col("persona_id"), F.col("player_description"), F.col("source_content"), F.col("source_topic"), F.col("score").alias("semantic_similarity"), F.lit("semantic").alias("matching_method"))
    found = best.where("vec_id is not null").join(personas, F.col("vec_id") == F.col("persona_id")).select(F.col("query_id").alias("id"), role.alias("role_data"))
    return templates.join(found, "id", "left")


def retrieve_docs(asked: DataFrame, docs: DataFrame, kind: str, k: int, threshold: float, vectors: Provider) -> DataFrame:
    """(query_id, doc_id, score, rank) of ``asked`` (query_id, text) among ``docs`` (doc_id, text).

    ``vector`` takes the ``k`` nearest and drops those whose similarity is under ``threshold``; ``bm25`` has no
    threshold.
    """
    if kind == "bm25":
        return bm25.retrieve(docs, asked, k).drop("scope")
    q = embed(asked.select("query_id", "text"), "text", "embedding", vectors)
    d = embed(docs.select(F.col("doc_id").alias("vec_id"), "text"), "text", "embedding", vectors)
    return nearest(q, d, k, threshold).withColumnRenamed("vec_id", "doc_id")


def generate(
    templates: DataFrame, quota: DataFrame, corpus: DataFrame, done: DataFrame | None = None, question: Provider = offline_question, answer: Provider = offline_answer, judge: Provider = offline_judge,
    k: int = 3, least: int = 1, kind: str = "vector", threshold: float = GenerationConfig.similarity_threshold, vectors: Provider | None = None, personas: DataFrame | None = None, test_size: int | None = None,
) -> DataFrame:
    """New pairs from ``templates`` (id, template, topic), ``quota`` (topic, allocated) and chunks (id, contents, extracted_date, entities).

    A hypothetical question and answer is the query for retrieval; the documents found, those near enough, are
    the context of the final answer, their latest date its time; a judge's gate ends it. With ``personas`` each
    template is matched with one, whose voice the prompts ask for. A pair's entities are those of the corpus
    that it mentions; a corpus without any gives the pair's own capitalised names. ``test_size`` caps the
    templates drawn. One pass for all templates, with a bounded number of provider calls for each.
    """
    vectors = vectors or offline_embedding()
    drawn = L.stratified_sample(resume(templates, done, "id") if done is not None else templates, quota, "id")
    drawn = L.test_sample(drawn, "id", test_size) if test_size is not None else drawn
    drawn = matched_personas(drawn, personas, vectors) if personas is not None else drawn.withColumn("role_data", F.lit(None).cast("struct<player_description:string>"))
    own = lambda c, kind: F.col(c) if c in templates.columns else F.lit(None).cast(kind)
    role = role_context(F.coalesce("role_data.player_description", F.lit("")))
    shape = template_context(F.col("template"), own("description", "string"), own("placeholders", "array<string>"))
    drawn = drawn.withColumn("_ask", F.concat_ws("\n\n", F.when(role != "", role), F.col("template")))
    asked = call(drawn, "_ask", "response", "string", question, fallback="")
    asked = asked.withColumn("h", hypothetical(F.col("response"), F.col("template")))
    asked = asked.select(F.col("id").alias("query_id"), "template", "topic", "role_data", F.concat_ws("\n\n", F.when(role != "", role), F.when(shape != "", shape)).alias("_context"), F.col("h.question").alias("question"), F.concat_ws(" ", "h.question", "h.answer").alias("text"))
    found = retrieve_docs(asked.select("query_id", "text"), corpus.select(F.col("id").alias("doc_id"), F.col("contents").alias("text")), kind, k, threshold, vectors)
    texts = found.join(corpus.select(F.col("id").alias("doc_id"), "contents", "extracted_date"), "doc_id")
    gathered = texts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "contents", "extracted_date", "score"))).alias("docs"))  # k a query
    pairs = asked.join(gathered, "query_id").withColumn("prompt", F.concat_ws("\n", F.when(F.col("_context") != "", F.col("_context")), "question", numbered_context(F.col("docs.contents"))))
    pairs = call(pairs, "prompt", "answer", "string", answer, fallback="").withColumn("answer", strip_prefixes(F.col("answer")))
    pairs = call(pairs.withColumn("prompt", F.concat_ws(" ||| ", "answer", F.array_join("docs.contents", " "))), "prompt", "quality", "string", judge, fallback="0")
    pairs = quality_gate(pairs.where(is_valid(F.col("question"), F.col("answer"))), F.col("quality").try_cast("int"), least)
    pairs = pairs.select(
        F.col("query_id").alias("template_id"), "template", F.col("topic").alias("question_topic"), L.choose_task(F.col("query_id")).alias("task_type"), "question", "answer",
        F.col("docs.contents").alias("references"), latest_date(F.col("docs.extracted_date")).alias("time"), F.col("docs.doc_id").alias("retrieved_doc_ids"), "role_data",
    )
    return with_entities(pairs, corpus)


def with_entities(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``pairs`` (template_id, question, answer) with ``entities``: those of the corpus that question or answer mention."""
    text = F.concat_ws(" ", "question", "answer")
    if "entities" not in corpus.columns:
        return pairs.withColumn("entities", dedup_in_order(extract_capitalized(text)))
    known = corpus.select(F.explode("entities").alias("entity"))
    held = mentions(pairs, known, text, "template_id").groupBy("template_id").agg(F.array_sort(F.collect_set("entity")).alias("_found"))
    return pairs.join(held, "template_id", "left").withColumn("entities", F.coalesce("_found", F.array().cast("array<string>"))).drop("_found")


def refine(pairs: DataFrame, provider: Provider) -> DataFrame:
    """``pairs`` (question, answer, references) with the provider's better wording, where it gives one.

    Pairs that are too long aren't sent; a pair without a usable reply keeps its question and answer.
    ``original_question``, ``original_answer`` and ``optimized`` tell what was done.
    """
    sent = F.coalesce(can_refine(F.col("question"), F.col("answer")), F.lit(False))
    prompt = F.concat_ws("\n", F.lit(REFINE), F.concat(F.lit("question: "), "question"), F.concat(F.lit("answer: "), "answer"), numbered_context(F.col("references")))
    replies = call(pairs.where(sent).withColumn("_prompt", prompt), "_prompt", "_reply", "string", provider, fallback="").drop("_prompt")
    both = replies.unionByName(pairs.where(~sent).withColumn("_reply", F.lit(None).cast("string")))
    both = both.withColumn("_r", qa_record(strip_fence(F.coalesce("_reply", F.lit("")))))
    ok = F.col("_r.question").isNotNull() & F.col("_r.answer").isNotNull()
    out = both.withColumns({"original_question": F.col("question"), "original_answer": F.col("answer"), "optimized": ok})
    return out.withColumns({"question": F.when(ok, F.col("_r.question")).otherwise(F.col("question")), "answer": F.when(ok, F.col("_r.answer")).otherwise(F.col("answer"))}).drop("_r", "_reply")
