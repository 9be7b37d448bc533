"""Plans around models, with providers so plain that SQL can say what they answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.answers import _PAIRS, _pairs
from tidemark.catalog.registry import query, table
from tidemark.catalog.retrieval import SQL_TOKENS, sql_top
from tidemark.functions.parsing import hypothetical
from tidemark.operators import evaluation as E
from tidemark.plans import config as C
from tidemark.plans import corpus as B
from tidemark.plans import evaluate as V
from tidemark.plans import generate as G
from tidemark.plans.providers import FAILED, call, embed


def _lengths(prompts: list[str]) -> list[str]:
    """The number of characters."""
    return [str(len(p)) for p in prompts]


def _picky(prompts: list[str]) -> list[str]:
    """Fails for whole batches and for prompts of an odd length."""
    if len(prompts) > 1 or len(prompts[0]) % 2:
        raise RuntimeError("no")
    return _lengths(prompts)


def _vectors(prompts: list[str]) -> list[list[float]]:
    if any(len(p) % 3 == 0 for p in prompts):
        raise RuntimeError("no")
    return [[float(len(p)), 1.0] for p in prompts]


def _entities(prompts: list[str]) -> list[str]:
    """No examples for texts of an odd length, so that these are asked about directly; the number of characters as an entity."""
    out = []
    for p in prompts:
        first, _, rest = p.partition("\n")
        if first.startswith("Write"):
            out.append("" if len(rest) % 2 else "some examples")
        elif first.startswith("List the named entities of these"):
            out.append("shown")
        else:
            out.append('{"entities": [{"text": "' + ("e" if first.startswith("Examples") else "d") + str(len(p)) + '"}]}')
    return out


def _rewritten(prompts: list[str]) -> list[str]:
    return ['```json\n{"question": "better ' + str(len(p)) + '?", "answer": "and longer"}\n```' if len(p) % 2 else "no" for p in prompts]


@query(f"SELECT conv_id, turn, CASE WHEN length(question) % 2 = 0 AND length(question) > 0 THEN CAST(length(question) AS VARCHAR) ELSE 'failed' END AS reply FROM {_PAIRS}")
def provider_retries(spark, sf):
    """A batch that fails is tried again, then prompt by prompt; a prompt that fails gets the fallback."""
    found = call(_pairs(spark, sf).select("conv_id", "turn", F.when(F.length("question") > 0, F.col("question")).otherwise("x").alias("question")), "question", "reply", "string", _picky, fallback="failed", wait=0.0)
    return found.select("conv_id", "turn", "reply")


@query(f"SELECT conv_id, turn, CASE WHEN length(question) % 3 = 0 THEN 0.0 ELSE CAST(length(question) AS DOUBLE) END AS first, CAST(CASE WHEN length(question) % 3 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS second FROM {_PAIRS}")
def embedding_fallback(spark, sf):
    """A text that can't be embedded gets the zero vector."""
    found = embed(_pairs(spark, sf).select("conv_id", "turn", "question"), "question", "v", _vectors, 2, wait=0.0)
    return found.select("conv_id", "turn", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


_PROMPT = "length(question) + 1 + length('Document 1:' || chr(10) || answer)"


@query(f"SELECT conv_id, turn, CASE WHEN ({_PROMPT}) % 2 = 0 THEN CAST({_PROMPT} AS VARCHAR) ELSE '{FAILED}' END AS answer, CASE WHEN ({_PROMPT}) % 2 = 1 THEN 'generation failed' END AS error FROM {_PAIRS}")
def answer_generation(spark, sf):
    """Answers from a question and its contexts; a failure has its text and an error."""
    rows = _pairs(spark, sf).select("conv_id", "turn", "question", F.array("answer").alias("contexts"))
    return V.answer(rows, _picky, wait=0.0).select("conv_id", "turn", "answer", "error")


_SCORED = "CASE WHEN length(trim(answer)) = 0 OR length(trim(question)) = 0 THEN 0.0 WHEN length(answer) % 4 <= 2 THEN (length(answer) % 4) / 2.0 ELSE 0.0 END"


@query(f"SELECT conv_id, turn, {_SCORED} AS correctness, CASE WHEN turn % 3 = 0 THEN 0.0 ELSE {_SCORED} END AS faithfulness FROM {_PAIRS}")
def judge_guard(spark, sf):
    """Judges' scores, 0 without an answer, a truth or, for faithfulness, contexts."""
    raw = (F.length("answer") % 4).cast("string")
    contexts = F.when(F.col("turn") % 3 > 0, F.array("question"))
    return _pairs(spark, sf).select("conv_id", "turn", E.guarded_judge(raw, F.col("answer"), F.col("question")).alias("correctness"), E.guarded_judge(raw, F.col("answer"), F.col("question"), contexts).alias("faithfulness"))


_DIRECT = len("List the named entities of this text as JSON:\n")
_SHOWN = len("Examples:\nsome examples\nshown\n\n")


@query(f"SELECT doc_id, CASE WHEN length(c) % 2 = 1 THEN 'd' || (length(c) + {_DIRECT}) ELSE 'e' || (length(c) + {_DIRECT + _SHOWN}) END AS entity FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents)")
def entity_extraction_steps(spark, sf):
    """Examples, entities of the examples, then the text behind them; without examples the text by itself."""
    chunks = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("contents"), F.array().cast("array<string>").alias("entities"))
    return B.extract_entities(chunks, _entities).select("doc_id", F.col("entities")[0].alias("entity"))


_ASKED = "length('Improve this pair.' || chr(10) || 'question: ' || question || chr(10) || 'answer: ' || answer || chr(10) || 'Document 1:' || chr(10) || conv_id)"
_SENT = f"length(question) <= 250 AND length(answer) <= 500 AND ({_ASKED}) % 2 = 1"


@query(f"SELECT conv_id, turn, md5(CASE WHEN {_SENT} THEN 'better ' || {_ASKED} || '?' ELSE question END) AS question, md5(CASE WHEN {_SENT} THEN 'and longer' ELSE answer END) AS answer, {_SENT} AS optimized FROM {_PAIRS}")
def pair_refinement(spark, sf):
    rows = _pairs(spark, sf).withColumn("references", F.array(F.col("conv_id").cast("string")))
    return G.refine(rows, _rewritten).select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"), "optimized")


_GAME = {"scope": "lang", "query_scope": "['de', 'en', 'es', 'fr', 'none'][item_id % 5 + 1]"}


@query(f"""{sql_top(**_GAME)},
l AS (SELECT scope, doc_id FROM (SELECT lang AS scope, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 6),
c AS (SELECT scope, query_id, doc_id FROM (SELECT DISTINCT scope, query_id FROM qt) JOIN l USING (scope)), f AS (SELECT query_id, doc_id, 0.0::DOUBLE AS score FROM c ANTI JOIN top USING (query_id, doc_id)),
u AS (SELECT query_id, doc_id, score FROM top UNION ALL SELECT query_id, doc_id, score FROM f),
t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM u QUALIFY r <= 3),
g AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS ids FROM t GROUP BY 1)
SELECT item_id, ['de', 'en', 'es', 'fr', 'none'][item_id % 5 + 1] AS game_name, coalesce(ids, '') AS ids, CASE WHEN item_id % 5 = 4 THEN 'no documents for this game' END AS error, 'bm25_k3' AS model_key FROM benchmark LEFT JOIN g ON query_id = item_id""")
def retrieval_by_game(spark, sf):
    """Every question against the documents of its game; a game without any gives an error row."""
    config = C.RetrievalConfig()
    game = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "none"))), (F.col("item_id") % 5 + 1).cast("int"))
    qa = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_index"), game.alias("game_name"), F.col("text").alias("question"))
    corpus = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("game_name"))
    found = V.retrieve_with(config, qa, corpus)
    return found.select(F.col("question_index").alias("item_id"), "game_name", F.array_join("retrieved_doc_ids", ",").alias("ids"), "error", F.lit(config.model_key).alias("model_key"))


@query(f"""WITH q AS (SELECT item_id AS query_id, CAST(len({SQL_TOKENS.format('text')}) % 7 AS DOUBLE) AS x FROM benchmark), d AS (SELECT p_partkey AS doc_id, CAST(p_size % 7 AS DOUBLE) AS x FROM part),
s AS (SELECT query_id, doc_id, round((q.x * d.x + 1) / (sqrt(q.x * q.x + 1) * sqrt(d.x * d.x + 1)), 6) AS score FROM q, d)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score >= 0.3 QUALIFY rank <= 3""")
def generation_retrieval(spark, sf):
    """Dense retrieval for generation: the nearest, less those under the threshold; a text is its number, beside one."""
    numbers = lambda prompts: [[float(p), 1.0] for p in prompts]
    from tidemark.functions.text import tokens

    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.size(tokens(F.coalesce("text", F.lit("")))) % 7).cast("string").alias("text"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 7).cast("string").alias("text"))
    return G.retrieve_docs(asked, docs, "vector", 3, C.GenerationConfig.similarity_threshold, numbers).select("query_id", "doc_id", "score", "rank")


@query("SELECT item_id, CASE WHEN n > 0 THEN n END AS n, first_entity FROM (SELECT item_id, count(e) AS n, min(e) AS first_entity FROM benchmark LEFT JOIN (SELECT DISTINCT n_name AS e FROM nation UNION SELECT 'the') ON contains(lower(text), lower(e)) GROUP BY item_id)")
def pair_entities(spark, sf):
    """The entities of the corpus that a pair mentions."""
    pairs = table(spark, sf, "benchmark").select(F.col("item_id").alias("template_id"), F.col("text").alias("question"), F.lit("").alias("answer"))
    corpus = table(spark, sf, "nation").select(F.array("n_name", F.lit("the")).alias("entities"))
    found = G.with_entities(pairs, corpus)
    return found.select(F.col("template_id").alias("item_id"), F.when(F.size("entities") > 0, F.size("entities").cast("long")).alias("n"), F.get("entities", F.lit(0)).alias("first_entity"))


def _scores(prompts: list[str]) -> list[str]:
    """A score for some, words for others, and no reply at all to the rest."""
    if any(len(p) % 4 == 3 for p in prompts):
        raise RuntimeError("no")
    return [{0: "2", 1: " 1", 2: "good"}[len(p) % 4] for p in prompts]


@query(f"SELECT conv_id, turn, CASE length(question) % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS score FROM {_PAIRS}")
def quality_scores(spark, sf):
    """What isn't a number, or isn't there, is 0."""
    found = call(_pairs(spark, sf), "question", "quality", "string", _scores, fallback="0", wait=0.0, in_flight=2)
    return found.select("conv_id", "turn", F.coalesce(F.trim("quality").try_cast("int"), F.lit(0)).alias("score"))


def _hypotheses(prompts: list[str]) -> list[str]:
    return [f"Question: q{len(p)}\nAnswer: a{len(p)}" if len(p) % 2 == 0 else "" for p in prompts]


@query(f"SELECT conv_id, turn, md5(CASE WHEN length(question) % 2 = 0 THEN 'q' || length(question) ELSE question END) AS question, CASE WHEN length(question) % 2 = 0 THEN 'a' || length(question) ELSE '' END AS answer FROM {_PAIRS}")
def hypothetical_pairs(spark, sf):
    """A question and an answer to search with, from a provider that sometimes has none."""
    found = call(_pairs(spark, sf), "question", "reply", "string", _hypotheses, fallback="", wait=0.0)
    found = found.withColumn("h", hypothetical(F.col("reply"), F.col("question")))
    return found.select("conv_id", "turn", F.md5("h.question").alias("question"), F.col("h.answer").alias("answer"))
