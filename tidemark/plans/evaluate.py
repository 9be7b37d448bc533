"""Retrieval, answers, judging and ranking, from QA pairs to a leaderboard row."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import Segmenter, numbered_context
from tidemark.operators import bm25, evaluation
from tidemark.operators.nearest import nearest
from tidemark.plans.config import RetrievalConfig, as_column
from tidemark.plans.providers import FAILED, WAIT, Provider, call, embed, offline_answer, offline_embedding, offline_judge
from tidemark.sources.scratch import kept
from tidemark.sources.writers import run_name, write_results

#: Documents found up to which they are broadcast.
BROADCAST_IDS = 500_000


def retrieve_for(qa: DataFrame, corpus: DataFrame, kind: str = "bm25", k: int = 3, vectors: Provider | None = None, segment: Segmenter | None = None) -> DataFrame:
    """``qa`` (question_index, game_name, question, ground_truth_doc_ids) with retrieved_doc_ids, contexts and ``error``.

    ``corpus`` has (game_name, doc_id, text); ids are unique in their game. A question whose game has no
    documents gets an error and an empty list; questions without any hit an empty list. ``kind`` is bm25, or
    vector, where questions meet the documents of their game block by block.
    """
    if kind == "bm25":
        asked = qa.select(F.col("question_index").alias("query_id"), F.col("question").alias("text"), "game_name")
        found = bm25.retrieve(corpus, asked, k, scope="game_name", padded=True, segment=segment).select(F.col("query_id").alias("question_index"), F.col("scope").alias("game_name"), "doc_id", "score", "rank")
    elif kind == "vector":
        vectors = vectors or offline_embedding()
        q = embed(qa.select(F.col("question_index").alias("query_id"), "game_name", "question"), "question", "embedding", vectors)
        d = embed(corpus.select(F.col("doc_id").alias("vec_id"), "game_name", "text"), "text", "embedding", vectors)
        found = nearest(q, d, k, scope="game_name").select(F.col("query_id").alias("question_index"), "game_name", F.col("vec_id").alias("doc_id"), "score", "rank")
    else:
        raise ValueError(f"no retriever {kind}")
    found = kept(found.where("doc_id is not null"), "found")  # k a question
    near = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    texts = corpus.select("game_name", "doc_id", "text").join(near, ["game_name", "doc_id"])
    gathered = texts.groupBy("question_index").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), "text", "score"))).alias("d"))  # k a question
    games = corpus.select("game_name").distinct().withColumn("known", F.lit(True))
    out = qa.join(gathered, "question_index", "left").join(games, "game_name", "left")
    empty = F.array().cast("array<string>")
    return out.select(*qa.columns, F.coalesce("d.id", empty).alias("retrieved_doc_ids"), F.coalesce("d.text", empty).alias("contexts"), F.when(F.col("known").isNull(), F.lit("no documents for this game")).alias("error"))


def retrieve_with(config: RetrievalConfig, qa: DataFrame, corpus: DataFrame, vectors: Provider | None = None) -> DataFrame:
    """``retrieve_for`` as a configuration says, with the configuration beside every row."""
    return retrieve_for(qa, corpus, config.retriever, config.k, vectors).withColumn("config", as_column(config))


def retrieve_to(path: str, qa: DataFrame, corpus: DataFrame, kind: str = "bm25", k: int = 3, vectors: Provider | None = None) -> DataFrame:
    """The results written to ``path`` and read again, with ``retrieval_time``: the batch's seconds over its rows."""
    began = time.monotonic()
    retrieve_for(qa, corpus, kind, k, vectors).write.mode("overwrite").parquet(path)
    seconds = time.monotonic() - began
    return evaluation.with_mean_time(qa.sparkSession.read.parquet(path), seconds).orderBy("question_index")


def answer(results: DataFrame, provider: Provider = offline_answer, contexts: int = 3, wait: float = WAIT) -> DataFrame:
    """``results`` with ``answer`` from the question and the first contexts.

    A prompt that fails at every try gives the failure text as its answer, and an ``error`` where there was none.
    """
    prompt = F.concat_ws("\n", "question", numbered_context(F.slice("contexts", 1, contexts)))
    out = call(results.withColumn("prompt", prompt), "prompt", "answer", "string", provider, fallback=FAILED, wait=wait).drop("prompt")
    before = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    return out.withColumn("error", F.coalesce(before, F.when(F.col("answer") == FAILED, F.lit("generation failed"))))


def answer_to(folder: str, results: DataFrame, model: str, provider: Provider = offline_answer, name: str | None = None) -> str:
    """Answers written as JSON lines under the run's name, or the one made of the model's; the path."""
    path = f"{folder}/{name or run_name('generation', model)}"
    write_results(answer(results, provider), path)
    return path


def judge(results: DataFrame, provider: Provider = offline_judge, normalize: bool = True) -> DataFrame:
    """``results`` (answer, ground_truth_answer, contexts) with correctness and faithfulness."""
    out = call(results.withColumn("p", F.concat_ws(" ||| ", "answer", "ground_truth_answer")), "p", "c_raw", "string", provider, fallback="0")
    out = call(out.withColumn("p", F.concat_ws(" ||| ", "answer", F.array_join("contexts", " "))), "p", "f_raw", "string", provider, fallback="0")
    truth = F.col("ground_truth_answer")
    return out.withColumns({
        "correctness": evaluation.guarded_judge(F.col("c_raw"), F.col("answer"), truth, None, normalize),
        "faithfulness": evaluation.guarded_judge(F.col("f_raw"), F.col("answer"), truth, F.col("contexts"), normalize),
    }).drop("p", "c_raw", "f_raw")


def evaluate(qa: DataFrame, corpus: DataFrame, k: int = 3, kind: str = "bm25", answers: Provider = offline_answer, judges: Provider = offline_judge) -> tuple[DataFrame, DataFrame]:
    """(retrieval metrics by game, judge means by game and over all)."""
    results = retrieve_for(qa, corpus, kind, k)
    measured = evaluation.per_query(results.select("game_name", F.col("retrieved_doc_ids").alias("retrieved"), F.col("ground_truth_doc_ids").alias("relevant")), (k,))
    judged = judge(answer(results, answers), judges)
    return evaluation.by_group(measured, "game_name", "k"), evaluation.judge_means(judged)
