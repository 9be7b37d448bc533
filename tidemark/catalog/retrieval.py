"""BM25, dense retrieval and persona matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, scratch, spread, table
from tidemark.operators import bm25 as B
from tidemark.operators import nearest as N
from tidemark.operators import vector as V

SQL_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"


def sql_scores(scope: str = "'all'", query_scope: str = "'all'") -> str:
    """CTEs up to ``scored`` (scope, query_id, doc_id, score)."""
    return f"""d AS (SELECT {scope} AS scope, doc_id, {SQL_TOKENS.format('text')} AS w FROM documents),
p AS (SELECT scope, doc_id, len(w) AS dl, unnest(w) AS token FROM d), tf AS (SELECT scope, doc_id, dl, token, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT scope, count(*) AS n_docs, avg(len(w)) AS avgdl FROM d GROUP BY scope), df AS (SELECT scope, token, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT {query_scope} AS scope, item_id AS query_id, unnest({SQL_TOKENS.format('text')}) AS token FROM benchmark), qt AS (SELECT scope, query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
scored AS (SELECT scope, query_id, doc_id, round(sum(qtf * (ln(n_docs / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 4) AS score FROM qt JOIN tf USING (scope, token) JOIN df USING (scope, token) JOIN st USING (scope) GROUP BY ALL)"""


def sql_top(k: int = 3, **scopes: str) -> str:
    return f"WITH {sql_scores(**scopes)}, top AS (SELECT *, row_number() OVER (PARTITION BY scope, query_id ORDER BY score DESC, doc_id DESC) AS rank FROM scored QUALIFY rank <= {k})"


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_results(spark, sf, k: int = 3):
    return B.retrieve(spread(spark, sf, "documents").select("doc_id", "text"), _items(spark, sf), k)


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS dl, token, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS token FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS w FROM documents)) GROUP BY ALL")
def bm25_postings(spark, sf):
    return B.postings(B.tokenized(table(spark, sf, "documents"))).select("doc_id", "dl", "token", "tf")


@query(f"WITH {sql_scores()} SELECT token, df, round(ln(n_docs / df), 6) AS idf FROM df JOIN st USING (scope)")
def bm25_df_idf(spark, sf):
    docs = B.tokenized(table(spark, sf, "documents"))
    return B.idf(B.postings(docs), B.corpus_stats(docs)).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {sql_scores()} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(DISTINCT token) FROM p) AS n_vocab FROM st")
def bm25_corpus_stats(spark, sf):
    docs = B.tokenized(table(spark, sf, "documents"))
    vocabulary = docs.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n_vocab"))
    return B.corpus_stats(docs).join(F.broadcast(vocabulary), F.lit(True)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_vocab")


@query(f"{sql_top()} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_topk(spark, sf):
    return bm25_results(spark, sf).select("query_id", "doc_id", "score", "rank")


_GAMES = {"scope": "lang", "query_scope": "['de', 'en', 'es', 'fr'][item_id % 4 + 1]"}


@query(f"{sql_top(**_GAMES)} SELECT scope AS game_name, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_topk_by_game(spark, sf):
    game = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("query_id") % 4 + 1).cast("int"))
    docs = spread(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("game_name"))
    return B.retrieve(docs, _items(spark, sf).withColumn("game_name", game), 3, scope="game_name").select(F.col("scope").alias("game_name"), "query_id", "doc_id", "score", "rank")


@query(f"""{sql_top().replace('FROM benchmark', "FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'zzqx' ELSE text END AS text FROM benchmark)")},
l AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 6), c AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM qt) CROSS JOIN l), f AS (SELECT query_id, doc_id, 0.0::DOUBLE AS score FROM c ANTI JOIN top USING (query_id, doc_id)),
u AS (SELECT query_id, doc_id, score FROM top UNION ALL SELECT query_id, doc_id, score FROM f)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS INTEGER) AS rank FROM u QUALIFY rank <= 3""")
def bm25_topk_padded(spark, sf):
    items = _items(spark, sf).withColumn("text", F.when(F.col("query_id") % 3 == 0, "zzqx").otherwise(F.col("text")))
    return B.retrieve(spread(spark, sf, "documents").select("doc_id", "text"), items, 3, padded=True).select("query_id", "doc_id", "score", "rank")


_SQL_COSINE = "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6)"
_SQL_PAIRS = f"SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_SQL_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"


def _asked(e):
    """Every id that 100 divides is searched for."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _nearest(spark, sf, k: int, threshold: float | None = None, itself: bool = True):
    """Among all vectors, the one searched for included or not."""
    e = table(spark, sf, "embeddings")
    return N.nearest(_asked(e), e, k, threshold, itself=itself)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_PAIRS}) QUALIFY rank <= 3")
def vector_topk(spark, sf):
    return _nearest(spark, sf, 3)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_PAIRS}) WHERE score >= 0.3 QUALIFY rank <= 10")
def vector_threshold(spark, sf):
    return _nearest(spark, sf, 10, 0.3)


@query(f"SELECT query_id, CASE WHEN score >= 0.6 THEN vec_id END AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_SQL_PAIRS})) WHERE r = 1")
def persona_best_match(spark, sf):
    return V.best_match(_nearest(spark, sf, 1))


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_PAIRS}) QUALIFY rank <= 5")
def persona_topk(spark, sf):
    return _nearest(spark, sf, 5)


_SQL_ALL_PAIRS = f"SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_SQL_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id"


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_ALL_PAIRS}) QUALIFY rank <= 3")
def vector_topk_all(spark, sf):
    return _nearest(spark, sf, 3, itself=False)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_ALL_PAIRS}) WHERE score >= 0.3 QUALIFY rank <= 10")
def vector_threshold_all(spark, sf):
    return _nearest(spark, sf, 10, 0.3, itself=False)


@query(f"SELECT query_id, CASE WHEN score >= 0.6 THEN vec_id END AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_SQL_ALL_PAIRS})) WHERE r = 1")
def persona_best_match_all(spark, sf):
    return V.best_match(_nearest(spark, sf, 1, itself=False))


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_ALL_PAIRS}) QUALIFY rank <= 5")
def persona_topk_all(spark, sf):
    return _nearest(spark, sf, 5, itself=False)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM ({_SQL_PAIRS}) QUALIFY rank <= 5")
def vector_index_topk(spark, sf):
    """Through an index, with the second step that makes its rows those of all pairs."""
    e, path = table(spark, sf, "embeddings"), scratch(spark, "vectors")
    N.build(e, path)
    return N.search(path, _asked(e), 5, probes=4, exact=True)


@query()
def vector_index_probed(spark, sf):
    """Through an index's nearest lists alone; a test holds its recall against all pairs."""
    e, path = table(spark, sf, "embeddings"), scratch(spark, "vectors")
    N.build(e, path)
    return N.search(path, _asked(e), 5)
