"""Inheritance, allocation and sampling. Topics are event types, templates are documents by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, table
from tidemark.operators import allocation as L
from tidemark.operators import qa as Q
from tidemark.operators import vector as V

N = 500
_COUNTS = "SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1"
_TARGETS = f"""WITH c AS ({_COUNTS}), p AS (SELECT topic, n, n / sum(n) OVER () AS proportion FROM c),
b AS (SELECT *, CAST(floor({N} * CAST(proportion AS DOUBLE)) AS BIGINT) AS base, row_number() OVER (ORDER BY proportion DESC, topic) AS r FROM p)
SELECT topic, n, base + CASE WHEN r = 1 THEN {N} - CAST(sum(base) OVER () AS BIGINT) ELSE 0 END AS target FROM b"""
_AVAILABLE = "SELECT event_type AS topic, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS available FROM events GROUP BY 1"
_PLAN = f"SELECT topic, target, coalesce(available, 0) AS available, least(target, coalesce(available, 0)) AS inherit, target - least(target, coalesce(available, 0)) AS generate FROM ({_TARGETS}) LEFT JOIN ({_AVAILABLE}) USING (topic)"


def _counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))


def _available(spark, sf):
    """A day with events of a type is one candidate of it."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count_distinct(F.col("ts").cast("date")).alias("available"))


def _plan(spark, sf):
    return L.inherit_plan(L.inherit_targets(_counts(spark, sf), N), _available(spark, sf))


@query(f"SELECT topic, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS proportion FROM ({_COUNTS})")
def type_proportions(spark, sf):
    return L.proportions(_counts(spark, sf)).withColumn("proportion", F.round("proportion", 6))


@query(_TARGETS)
def inherit_targets(spark, sf):
    return L.inherit_targets(_counts(spark, sf), N)


@query(_PLAN)
def inherit_plan(spark, sf):
    return _plan(spark, sf)


@query(f"SELECT CAST(sum(inherit) AS BIGINT) AS inherit_count, CAST(1000 - sum(inherit) AS BIGINT) AS discarded, CAST(sum(available) AS BIGINT) AS candidate_count, CAST(sum(generate) AS BIGINT) AS generation_needed FROM ({_PLAN})")
def inherit_summary(spark, sf):
    return L.plan_summary(_plan(spark, sf), F.lit(1000))


@query("SELECT doc_id, 3 AS segment_id, 2 AS inherited_from, 'inherited' AS inheritance_status FROM labels")
def inherit_stamp(spark, sf):
    return Q.stamp_inherited(table(spark, sf, "labels").select("doc_id"), 3)


_TOPICS = "SELECT source AS topic, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS proportion, CAST(count(*) FILTER (lang = 'fr') AS BIGINT) AS inherited, CAST(count(*) FILTER (lang = 'en' AND source <> 'src3') AS BIGINT) AS n_templates FROM documents GROUP BY source"
_ALLOCATION = f"""WITH t AS ({_TOPICS}), i AS (SELECT *, sum(inherited) OVER () AS inh FROM t),
o AS (SELECT *, greatest(0, CAST(floor(({N} + inh) * proportion) AS BIGINT) - inherited) AS need FROM i WHERE n_templates > 0),
b AS (SELECT *, coalesce(sum(need) OVER (ORDER BY proportion DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY proportion DESC, topic) - 1 AS r, count(*) OVER () AS m FROM o),
g AS (SELECT *, least(need, greatest(0, {N} - before)) AS greedy FROM b), x AS (SELECT *, {N} - sum(greedy) OVER () AS rest FROM g)
SELECT topic, need, CAST(greedy + rest // m + CASE WHEN r < rest % m THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM x"""


def _allocation(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "fr").alias("inherited"), F.count_if((F.col("lang") == "en") & (F.col("source") != "src3")).alias("n_templates"))
    return L.sampler_allocation(L.proportions(rows), N)


@query(_ALLOCATION)
def sampler_allocation(spark, sf):
    return _allocation(spark, sf)


@query(f"SELECT doc_id, topic FROM (SELECT doc_id, source AS topic, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) JOIN ({_ALLOCATION}) USING (topic) WHERE r <= allocated")
def stratified_sample(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"))
    return L.stratified_sample(rows, _allocation(spark, sf), "doc_id").select("doc_id", "topic")


@query("SELECT o_orderkey, CASE WHEN u < 0.7 / 1.0 THEN 'factual' WHEN u < (0.7 + 0.1) / (0.7 + 0.1 + 0.2) THEN 'summarization' ELSE 'multi_hop' END AS task_type FROM (SELECT o_orderkey, CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 7)) AS BIGINT) / 268435456.0 AS u FROM orders)")
def task_type_choice(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", L.choose_task(F.col("o_orderkey")).alias("task_type"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return Q.resume(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT coalesce(source, 'UNCATEGORIZED') AS topic, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents GROUP BY 1")
def templates_by_topic(spark, sf):
    return table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("UNCATEGORIZED")).alias("topic")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query(f"SELECT CASE WHEN sum(generate) > 0 THEN CAST(sum(generate) AS BIGINT) ELSE greatest(0, {N} - CAST(sum(inherit) AS BIGINT)) END AS remaining FROM ({_PLAN})")
def remaining_target(spark, sf):
    plan = _plan(spark, sf).agg(F.sum("generate").alias("g"), F.sum("inherit").alias("i"))
    return plan.select(L.remaining_target(F.when(F.col("g") > 0, F.col("g")), N, F.col("i")).alias("remaining"))


@query("SELECT min_by(doc_id, md5('42|' || doc_id)) AS doc_id FROM documents WHERE source = 'src2'")
def random_template(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"))
    return L.random_template(rows, "doc_id", "src2").select("doc_id")


@query(f"SELECT topic, least(target, available) AS base, 0 AS extra FROM ({_PLAN})")
def budgeted_resample(spark, sf):
    return L.budgeted_resample(_plan(spark, sf).select("topic", "target", "available"), N)


_TAXONOMY = [(0, "src1", None, "M1", "first main"), (0, "src1", "src2", "S2", "sub two"), (1, "src3", None, "M3", "third main"), (1, "src3", "none", "src4", "by code"), (2, "src9", "src1", "X", "shadowed")]
_SQL_TAXONOMY = "(VALUES " + ", ".join(f"({p}, '{m}', {repr(s) if s else 'NULL'}, '{c}', '{d}')" for p, m, s, c, d in _TAXONOMY) + ") AS t(position, main, sub, code, description)"


@query(f"""WITH k AS (SELECT main AS topic, 0 AS level, position, description FROM {_SQL_TAXONOMY} WHERE sub IS NULL UNION ALL SELECT sub, 1, position, description FROM {_SQL_TAXONOMY} WHERE sub IS NOT NULL UNION ALL SELECT code, 2, position, description FROM {_SQL_TAXONOMY} WHERE sub IS NOT NULL),
f AS (SELECT topic, arg_min(description, level * 1000 + position) AS d FROM k GROUP BY topic)
SELECT topic, coalesce(d, topic) AS description, n FROM (SELECT source AS topic, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN f USING (topic)""")
def topic_lookup(spark, sf):
    taxonomy = spark.createDataFrame(_TAXONOMY, "position int, main string, sub string, code string, description string")
    return Q.topic_description(table(spark, sf, "documents").groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n")), taxonomy)


@query("SELECT topic, count(DISTINCT persona_id) AS n_personas, min(persona_id) AS first_persona FROM (SELECT doc_id AS persona_id, unnest(string_split(source || ' | ' || lang || '|', '|')) AS t FROM documents), LATERAL (SELECT trim(t) AS topic) WHERE topic <> '' GROUP BY topic")
def persona_topic_index(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("persona_id"), F.concat("source", F.lit(" | "), "lang", F.lit("|")).alias("source_topic"))
    return V.personas_by_topic(rows)


_ALL_AVAILABLE = "SELECT event_type AS topic, CAST(count(DISTINCT user_id) AS BIGINT) AS available FROM events GROUP BY 1"
_ALL_PLAN = _PLAN.replace(_AVAILABLE, _ALL_AVAILABLE)


def _all_plan(spark, sf):
    """A user who has events of a type is one candidate of it; every event counts for the targets and the candidates."""
    available = table(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count_distinct("user_id").alias("available"))
    return L.inherit_plan(L.inherit_targets(_counts(spark, sf), N), available)


@query(_ALL_PLAN)
def inherit_plan_all(spark, sf):
    return _all_plan(spark, sf)


@query(f"SELECT CAST(sum(inherit) AS BIGINT) AS inherit_count, CAST(1000 - sum(inherit) AS BIGINT) AS discarded, CAST(sum(available) AS BIGINT) AS candidate_count, CAST(sum(generate) AS BIGINT) AS generation_needed FROM ({_ALL_PLAN})")
def inherit_summary_all(spark, sf):
    return L.plan_summary(_all_plan(spark, sf), F.lit(1000))


@query(f"SELECT CASE WHEN sum(generate) > 0 THEN CAST(sum(generate) AS BIGINT) ELSE greatest(0, {N} - CAST(sum(inherit) AS BIGINT)) END AS remaining FROM ({_ALL_PLAN})")
def remaining_target_all(spark, sf):
    plan = _all_plan(spark, sf).agg(F.sum("generate").alias("g"), F.sum("inherit").alias("i"))
    return plan.select(L.remaining_target(F.when(F.col("g") > 0, F.col("g")), N, F.col("i")).alias("remaining"))


@query(f"SELECT topic, least(target, available) AS base, 0 AS extra FROM ({_ALL_PLAN})")
def budgeted_resample_all(spark, sf):
    return L.budgeted_resample(_all_plan(spark, sf).select("topic", "target", "available"), N)


@query("SELECT doc_id, 3 AS segment_id, 2 AS inherited_from, 'inherited' AS inheritance_status FROM documents")
def inherit_stamp_all(spark, sf):
    return Q.stamp_inherited(table(spark, sf, "documents").select("doc_id"), 3)
