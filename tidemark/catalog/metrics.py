"""Retrieval metrics of BM25 over documents, with containment as ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import kept, query, spread, table
from tidemark.catalog.retrieval import bm25_results, sql_top
from tidemark.operators import evaluation as E
from tidemark.operators.qa import containing, doc_ids, model_key, status_counts


def ground_truth(spark, sf):
    """(query_id, doc_id): documents that contain an item's text."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return containing(spread(spark, sf, "documents").select("doc_id", "text"), items).select("query_id", "doc_id")


def results(spark, sf, k: int = 5):
    """(query_id, retrieved, relevant, n_relevant, n_different, game_name, task_type, segment_id, seconds, error), one row an item.

    ``relevant`` has those of the relevant ids that are retrieved; of the others only the number is told.
    """
    top = kept(bm25_results(spark, sf, k).select("query_id", "doc_id", "rank"), "top")
    truth = kept(ground_truth(spark, sf).groupBy("query_id", "doc_id").agg(F.count("*").alias("n")), "truth")
    hits = truth.join(F.broadcast(top.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")  # k a query
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("relevant"))
    some = F.col("doc_id").isNotNull()
    numbers = truth.groupBy("query_id").agg(F.sum(F.when(some, F.col("n"))).alias("n_relevant"), F.count_if(some).alias("n_different"))
    top = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("retrieved"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string")).alias("game_name"), F.concat(F.lit("t"), (F.col("item_id") % 4).cast("string")).alias("task_type"), (F.col("item_id") % 5).cast("int").alias("segment_id"), ((F.col("item_id") % 7) / 10.0).alias("seconds"), F.when(F.col("item_id") % 9 == 0, "failed").alias("error"))
    return q.join(top, "query_id", "left").join(hits, "query_id", "left").join(numbers, "query_id", "left")


def sql_measured(k_values=(3,), dedup: bool = True) -> str:
    """CTEs up to ``m`` (query_id, k, metrics, n_rel, game_name, task_type, segment_id)."""
    return f"""{sql_top(5)}, gt AS (SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
ks AS (SELECT unnest({list(k_values)}) AS k), hits AS (SELECT t.query_id, k, count(*) AS hits, sum(1 / log2(t.rank + 1)) AS dcg FROM top t JOIN gt USING (query_id, doc_id), ks WHERE t.rank <= k GROUP BY ALL),
n AS (SELECT query_id, k, count(*) AS n FROM top, ks WHERE rank <= k GROUP BY ALL), rel AS (SELECT query_id, count(*) AS n_rel FROM gt GROUP BY 1),
base AS (SELECT item_id AS query_id, k, 'g' || (item_id % 3) AS game_name, 't' || (item_id % 4) AS task_type, CAST(item_id % 5 AS INTEGER) AS segment_id FROM benchmark, ks),
x AS (SELECT base.*, coalesce(n_rel, 0) AS n_rel, coalesce(hits, 0) / coalesce(n_rel, 1) AS recall, CASE WHEN n > 0 THEN coalesce(hits, 0) / n ELSE 0 END AS precision, coalesce(dcg, 0) / coalesce((SELECT sum(1 / log2(i + 1)) FROM range(1, least(base.k, n_rel) + 1) r(i)), 1) AS ndcg FROM base LEFT JOIN hits USING (query_id, k) LEFT JOIN n USING (query_id, k) LEFT JOIN rel USING (query_id)),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x)"""


_MEANS = ", ".join(f"round(coalesce(avg({n}) FILTER (n_rel > 0), 0), 6) AS {n}" for n in E.NAMES)
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in E.NAMES)


def _rounded(df):
    return df.withColumns({n: F.round(n, 6) for n in E.NAMES})


@query("SELECT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def ground_truth_docs(spark, sf):
    return ground_truth(spark, sf)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN 'm' || doc_id ELSE 'd' || doc_id END END AS with_fallback, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'm' || doc_id ELSE '' END AS without FROM documents")
def doc_id_fallback(spark, sf):
    i = F.col("doc_id").cast("string")
    meta = F.when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 3 != 0), F.concat(F.lit("m"), i))
    own = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), i)).otherwise("")
    docs = F.array(F.struct(own.alias("id"), F.create_map(F.lit("id"), meta).alias("metadata")))
    rows = table(spark, sf, "documents").withColumn("docs", docs)
    return rows.select("doc_id", F.array_join(doc_ids(F.col("docs")), ",").alias("with_fallback"), F.array_join(doc_ids(F.col("docs"), False), ",").alias("without"))


@query(f"{sql_measured((1, 3, 5))} SELECT query_id, CAST(k AS INTEGER) AS k, n_rel > 0 AS valid, {_ROUNDED} FROM m")
def metrics_per_query(spark, sf):
    return _rounded(E.per_query(results(spark, sf).select("query_id", "retrieved", "relevant", "n_relevant", "n_different"), (1, 3, 5)))


@query(f"{sql_measured((3,))}, r AS (SELECT query_id, round(coalesce(sum(CASE WHEN g.doc_id IS NOT NULL THEN 1 / log2(2 * t.rank) + 1 / log2(2 * t.rank + 1) ELSE 0 END) FILTER (t.rank <= 2), 0), 6) AS z FROM top t LEFT JOIN gt g USING (query_id, doc_id) GROUP BY 1) SELECT query_id, round(CASE WHEN n_rel > 0 THEN z / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(4, n_rel) + 1) q(i)) ELSE 0 END, 4) AS ndcg FROM r JOIN m USING (query_id)")
def ndcg_no_dedup(spark, sf):
    twice = F.flatten(F.transform(F.slice("retrieved", 1, 2), lambda x: F.array(x, x)))
    rows = results(spark, sf).where("retrieved is not null").withColumn("retrieved", twice).select("query_id", "retrieved", "relevant", "n_relevant", "n_different")
    return E.per_query(rows, (4,), dedup=False).select("query_id", F.round("ndcg", 4).alias("ndcg"))


@query(f"{sql_measured((1, 3, 5))} SELECT CAST(k AS INTEGER) AS k, {_MEANS}, count(*) AS total_queries, count(*) FILTER (n_rel > 0) AS valid_queries, round(avg(CASE WHEN n_rel > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM m GROUP BY k")
def metrics_overall(spark, sf):
    return E.overall(E.per_query(results(spark, sf), (1, 3, 5)))


@query(f"{sql_measured()} SELECT game_name, CAST(k AS INTEGER) AS k, {_MEANS}, count(*) AS n FROM m WHERE n_rel > 0 GROUP BY ALL")
def metrics_by_game(spark, sf):
    return E.by_group(E.per_query(results(spark, sf)), "game_name", "k")


@query(f"{sql_measured((1, 3))}, e AS (SELECT 'task_type' AS dimension, task_type AS value, * FROM m UNION ALL SELECT 'segment_id', CAST(segment_id AS VARCHAR), * FROM m) SELECT dimension, value, CAST(k AS INTEGER) AS k, {_MEANS}, count(*) AS n FROM e WHERE n_rel > 0 GROUP BY ALL")
def metrics_by_dimension(spark, sf):
    return E.by_dimensions(E.per_query(results(spark, sf), (1, 3)), ("task_type", "segment_id"))


@query(f"{sql_measured((1, 3))}, s AS (SELECT CASE WHEN k = 1 THEN 'bm25_k1' ELSE 'dense_k3' END AS model_key, segment_id, avg(recall) AS recall, avg(precision) AS precision, avg(f1) AS f1, avg(ndcg) AS ndcg FROM m WHERE n_rel > 0 GROUP BY ALL) SELECT model_key, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1, round(avg(ndcg), 6) AS ndcg, count(*) AS n_segments FROM s GROUP BY 1")
def metrics_cross_segment(spark, sf):
    rows = E.per_query(results(spark, sf), (1, 3))
    key = model_key(F.when(F.col("k") == 1, "bm25").otherwise("vector"), F.lit("dense"), F.col("k"))
    return E.cross_segment(rows.withColumn("model_key", key))


@query("SELECT round(avg(s), 6) AS mean_time, round(median(s), 6) AS median_time, count(*) AS n FROM (SELECT (item_id % 7) / 10.0 AS s FROM benchmark) WHERE s > 0")
def timing_stats(spark, sf):
    return E.timing(table(spark, sf, "benchmark").select(((F.col("item_id") % 7) / 10.0).alias("seconds")), "seconds")


@query("SELECT 'g' || (item_id % 3) AS game_name, count(*) AS total, count(*) FILTER (item_id % 9 <> 0) AS success, count(*) FILTER (item_id % 9 = 0) AS errors FROM benchmark GROUP BY 1")
def run_status_by_game(spark, sf):
    return status_counts(table(spark, sf, "benchmark").select(F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string")).alias("game_name"), F.when(F.col("item_id") % 9 == 0, "failed").alias("error")))


