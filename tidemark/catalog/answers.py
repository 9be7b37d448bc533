"""Gates, parsers, judges, submissions and the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, table
from tidemark.functions import metrics as M
from tidemark.functions import parsing as P
from tidemark.operators import evaluation as E
from tidemark.operators import leaderboard as B
from tidemark.operators import qa as Q

_PAIRS = "(SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"


def _pairs(spark, sf):
    return Q.next_answer(table(spark, sf, "conversations"))


@query(f"SELECT conv_id, turn, length(trim(question)) >= 5 AND length(trim(answer)) >= 10 AS is_valid FROM {_PAIRS}")
def qa_validity(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", Q.is_valid(F.col("question"), F.col("answer")).alias("is_valid"))


@query(f"SELECT conv_id, turn, length(question) <= 250 AND length(answer) <= 500 AS can_refine FROM {_PAIRS}")
def refine_length_gate(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", Q.can_refine(F.col("question"), F.col("answer")).alias("can_refine"))


@query("SELECT count(*) AS total, count(*) FILTER (quality + (1 - toxic) * quality >= 1) AS qualified, count(*) FILTER (quality + (1 - toxic) * quality < 1) AS discarded FROM labels")
def quality_gate(spark, sf):
    return Q.quality_counts(table(spark, sf, "labels"), F.expr("quality + (1 - toxic) * quality"))


@query("SELECT doc_id, CASE WHEN s IN (0, 1, 2) THEN s / 2.0 ELSE 0.0 END AS halved, CASE WHEN s IN (0, 1, 2) THEN s * 1.0 ELSE 0.0 END AS raw FROM (SELECT doc_id, CAST(quality + (1 - toxic) * quality + CASE WHEN doc_id % 10 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS s FROM labels)")
def judge_normalize(spark, sf):
    s = F.expr("cast(quality + (1 - toxic) * quality + if(doc_id % 10 = 0, 5, 0) as string)")
    return table(spark, sf, "labels").select("doc_id", M.judge_score(s).alias("halved"), M.judge_score(s, False).alias("raw"))


@query("""WITH x AS (SELECT lang AS game_name, (quality + (1 - toxic) * quality) / 2.0 AS c, quality * 1.0 AS f FROM labels JOIN documents USING (doc_id))
SELECT game_name, round(avg(c), 6) AS correctness, round(avg(f), 6) AS faithfulness, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'all', round(avg(c), 6), round(avg(f), 6), count(*) FROM x""")
def generation_scores(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("game_name")), "doc_id")
    score = M.judge_score(F.expr("cast(quality + (1 - toxic) * quality as string)"))
    return E.judge_means(rows.select("game_name", score.alias("correctness"), F.col("quality").cast("double").alias("faithfulness")))


@query("SELECT count(*) AS total, count(*) FILTER (trim(a) <> '') AS answered, round(count(*) FILTER (trim(a) <> '') / count(*), 6) AS rate, round(sum(length(a)) FILTER (trim(a) <> '') / count(*) FILTER (trim(a) <> ''), 6) AS avg_length FROM (SELECT CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS a FROM conversations)")
def answer_stats(spark, sf):
    return E.answer_statistics(table(spark, sf, "conversations").select(F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("answer")))


@query("SELECT l_returnflag, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT l_returnflag, l_quantity - 10 AS v FROM lineitem) WHERE v >= 0 GROUP BY 1")
def metric_statistics(spark, sf):
    return E.metric_statistics(table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") - 10).alias("v")), "v", "l_returnflag")


_LADDER = "CASE doc_id % 5 WHEN 0 THEN 'so: <json> {\"a\": ' || doc_id || '} </json> end' WHEN 1 THEN 'x ```json\n{\"b\": ' || doc_id || '}\n``` y' WHEN 2 THEN '```text {\"c\": ' || doc_id || '} ```' WHEN 3 THEN 'plain {\"d\": {\"e\": ' || doc_id || '}} tail' ELSE 'no braces ' || doc_id END"


def _ladder():
    i = F.col("doc_id").cast("string")
    texts = [F.concat(F.lit('so: <json> {"a": '), i, F.lit("} </json> end")), F.concat(F.lit('x ```json\n{"b": '), i, F.lit("}\n``` y")), F.concat(F.lit('```text {"c": '), i, F.lit("} ```")), F.concat(F.lit('plain {"d": {"e": '), i, F.lit("}} tail")), F.concat(F.lit("no braces "), i)]
    return F.element_at(F.array(*texts), (F.col("doc_id") % 5 + 1).cast("int"))


@query(f"""SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?s)<json>\\s*(.*?)\\s*</json>', 1), ''), nullif(regexp_extract(t, '(?s)```json\\s*(.*?)\\s*```', 1), ''), nullif(regexp_extract(t, '(?s)```[a-zA-Z]*\\s*(\\{{.*?\\}})\\s*```', 1), ''), nullif(regexp_extract(t, '(?s)(\\{{.*\\}})', 1), ''), '') AS body FROM (SELECT doc_id, {_LADDER} AS t FROM documents)""")
def json_extract_ladder(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.json_body(_ladder()).alias("body"))


_SQL_QUOTED = "b || CASE WHEN (length(b) - length(replace(b, '\"', ''))) % 2 = 1 THEN '\"' ELSE '' END"


@query(f"""WITH t AS (SELECT doc_id, '{{"a": [' || doc_id || ', {{"t": "' || substr(source, 1, CAST(doc_id % 4 AS INTEGER)) || CASE doc_id % 3 WHEN 0 THEN '...' WHEN 1 THEN '"...' ELSE '"}}]}}' END AS t FROM documents),
q AS (SELECT doc_id, t, {_SQL_QUOTED} AS q FROM (SELECT doc_id, t, regexp_replace(t, '\\.\\.\\.$', '') AS b FROM t))
SELECT doc_id, CASE WHEN ends_with(t, '...') THEN q || repeat('}}', greatest(0, (length(q) - length(replace(q, '{{', ''))) - (length(q) - length(replace(q, '}}', ''))))) || repeat(']', greatest(0, (length(q) - length(replace(q, '[', ''))) - (length(q) - length(replace(q, ']', ''))))) ELSE t END AS repaired FROM q""")
def json_truncation_repair(spark, sf):
    i = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, "...").when(F.col("doc_id") % 3 == 1, '"...').otherwise('"}]}')
    t = F.concat(F.lit('{"a": ['), i, F.lit(', {"t": "'), F.substring("source", F.lit(1), (F.col("doc_id") % 4).cast("int")), tail)
    return table(spark, sf, "documents").select("doc_id", P.repair_truncated(t).alias("repaired"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'q' || conv_id WHEN turn % 4 = 2 THEN 'first' ELSE 'template' END AS question, CASE WHEN turn % 4 = 0 THEN 'a' || conv_id WHEN turn % 4 = 2 THEN 'second' || chr(10) || 'third' ELSE 'only ' || conv_id END AS answer FROM {_PAIRS}""")
def hypothetical_parse(spark, sf):
    c = F.col("conv_id").cast("string")
    labelled = F.concat(F.lit("Question: old\nquestion： q"), c, F.lit("\n\n answer: a"), c)
    response = F.when(F.col("turn") % 4 == 0, labelled).when(F.col("turn") % 4 == 2, "\n first \n second\nthird").otherwise(F.concat(F.lit("only "), c))
    return _pairs(spark, sf).withColumn("h", P.hypothetical(response, F.lit("template"))).select("conv_id", "turn", "h.question", "h.answer")


@query("SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS md5 FROM conversations")
def response_prefix_strip(spark, sf):
    opened = F.concat(F.when(F.col("turn") % 2 == 0, "Answer:  ").otherwise("  RESPONSE: The answer is "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(P.strip_prefixes(opened)).alias("md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'o' || lang WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN source ELSE 'unknown' END AS game_name FROM documents")
def game_name_chain(spark, sf):
    part = lambda k, c: F.when(F.col("doc_id") % 4 == k, c)
    return table(spark, sf, "documents").select("doc_id", Q.game_name(part(0, F.concat(F.lit("o"), "lang")), part(1, F.col("lang")), part(2, F.col("source"))).alias("game_name"))


_GAMES = ["g0", "g1", "g2"]
_VALUES = {"recall": ("l_discount", 10), "f1": ("l_tax", 10), "ndcg": ("l_quantity", 0.02), "correctness": ("l_discount", 5), "faithfulness": ("l_tax", 5)}
#: Values are cut, not rounded, to four digits: engines round halves differently.
_SQL_CUT = ", ".join(f"floor(CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 * {f} * 10000) / 10000 {'* CASE WHEN l_suppkey % 13 = 0 THEN 9 ELSE 1 END ' * (m == 'faithfulness')}AS {m}" for m, (c, f) in _VALUES.items())
#: Some systems lack a game: its lines are of the fourth one, which counts for nobody.
_GAME = "CASE WHEN l_suppkey % 7 = 0 AND l_linenumber % 4 = 1 THEN 3 ELSE l_linenumber % 4 END"
_SQL_SUBMISSIONS = f"""(SELECT 's' || l_suppkey AS system_name, 'g' || ({_GAME}) AS game, CASE WHEN l_suppkey % 9 = 0 AND ({_GAME}) = 3 THEN '0' ELSE CAST(CAST(max(l_linenumber) AS INTEGER) AS VARCHAR) END AS topk,
{_SQL_CUT} FROM lineitem GROUP BY l_suppkey, {_GAME})"""


def submissions(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", F.expr(_GAME).alias("g"))
    cut = [(F.floor(F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count("*") / 100 * f * 10000) / 10000).alias(m) for m, (c, f) in _VALUES.items()]
    rows = rows.agg(F.max("l_linenumber").alias("topk"), *cut).withColumn("faithfulness", F.col("faithfulness") * F.when(F.col("l_suppkey") % 13 == 0, 9).otherwise(1))
    rows = rows.withColumn("topk", F.when((F.col("l_suppkey") % 9 == 0) & (F.col("g") == 3), "0").otherwise(F.col("topk").cast("string")))
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("system_name"), F.concat(F.lit("g"), F.col("g").cast("string")).alias("game"), *B.METRICS)


_BAD = "coalesce(TRY_CAST(topk AS DOUBLE) <= 0 OR " + " OR ".join(f"{m} < 0 OR {m} > 1" for m in B.METRICS[1:]) + ", true)"


@query(f"SELECT *, n_invalid = 0 AND missing = 0 AS is_valid FROM (SELECT system_name, count(*) AS n_games, count(*) FILTER ({_BAD}) AS n_invalid, CAST(3 - count(DISTINCT game) FILTER (game <> 'g3') AS BIGINT) AS missing FROM {_SQL_SUBMISSIONS} GROUP BY 1)")
def submission_validate(spark, sf):
    return B.validate(submissions(spark, sf), _GAMES)


_SQL_AVERAGE = f"SELECT system_name, CAST(arg_min(CAST(topk AS DOUBLE), game) AS INTEGER) AS topk, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in B.METRICS[1:]) + f" FROM {_SQL_SUBMISSIONS} WHERE game <> 'g3' GROUP BY 1"
_SQL_SCORED = f"SELECT system_name, round((recall + f1 + ndcg) / 3, 10) AS retrieval_score, round(0.75 * correctness + 0.25 * faithfulness, 10) AS generation_score, round(0.25 * ((recall + f1 + ndcg) / 3) + 0.75 * (0.75 * correctness + 0.25 * faithfulness), 10) AS total_score FROM ({_SQL_AVERAGE})"


@query(_SQL_AVERAGE)
def submission_average(spark, sf):
    return B.average(submissions(spark, sf), _GAMES)


def _scored(spark, sf):
    names = ("retrieval_score", "generation_score", "total_score")
    return B.scored(B.average(submissions(spark, sf), _GAMES)).select("system_name", *(F.round(n, 10).alias(n) for n in names))


@query(_SQL_SCORED)
def leaderboard_scores(spark, sf):
    return _scored(spark, sf)


@query(f"""WITH s AS ({_SQL_SCORED}), e AS (SELECT CAST(substr(system_name, 2) AS BIGINT) AS seq, system_name, floor(total_score * CASE WHEN CAST(substr(system_name, 2) AS BIGINT) % 2 = 0 THEN 40 ELSE 50 END) / 50 AS total_score, 0 AS age FROM s WHERE CAST(substr(system_name, 2) AS BIGINT) % 3 > 0),
n AS (SELECT CAST(substr(system_name, 2) AS BIGINT) + 100000 AS seq, system_name, floor(total_score * 50) / 50 AS total_score, 1 AS age FROM s WHERE CAST(substr(system_name, 2) AS BIGINT) % 3 < 2),
m AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY system_name ORDER BY total_score DESC, age, seq) = 1)
SELECT seq, system_name, total_score, CAST(row_number() OVER (ORDER BY total_score DESC, seq, system_name) AS INTEGER) AS rank FROM m""")
def leaderboard_merge(spark, sf):
    s = _scored(spark, sf).withColumn("seq", F.substring("system_name", 2, 20).cast("long"))
    existing = s.where("seq % 3 > 0").select("seq", "system_name", (F.floor(F.col("total_score") * F.when(F.col("seq") % 2 == 0, 40).otherwise(50)) / 50).alias("total_score"))
    new = s.where("seq % 3 < 2").select((F.col("seq") + 100000).alias("seq"), "system_name", (F.floor(F.col("total_score") * 50) / 50).alias("total_score"))
    return B.ranked(B.merge(existing, new))
