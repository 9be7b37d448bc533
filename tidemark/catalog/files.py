"""Sources and sinks: whole tables are written in the formats of the engine, read again by its readers and selected from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.answers import _SQL_SCORED, _pairs, _scored, submissions
from tidemark.catalog.answers import _PAIRS, _SQL_SUBMISSIONS
from tidemark.catalog.registry import query, scratch, table
from tidemark.catalog.retrieval import _SQL_COSINE, _items, sql_top
from tidemark.operators import leaderboard as B
from tidemark.operators import nearest as N
from tidemark.operators import vector as V
from tidemark.operators.evaluation import with_mean_time
from tidemark.plans import config as C
from tidemark.plans import index as I
from tidemark.sources import readers as R
from tidemark.sources import writers as W

_SEGMENT = "CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 4 END"


def _json(df, path):
    """Rows of one column as lines of text."""
    df.write.text(path)
    return path


# segments and source files


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS position, CAST(r_regionkey AS INTEGER) AS segment_id, '202' || r_regionkey || '-01-01' AS start_date, '202' || (r_regionkey + 1) || '-01-01' AS end_date, CAST(n AS BIGINT) AS n FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1) USING (r_regionkey)")
def segment_config_scan(spark, sf):
    nations = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    year = lambda c: F.concat(F.lit("202"), c.cast("string"), F.lit("-01-01"))
    k = F.col("r_regionkey").cast("int")
    one = F.struct(k.alias("segment_id"), year(k).alias("start_date"), year(k + 1).alias("end_date"), F.create_map(F.lit("nations"), F.col("n")).alias("type_distribution"))
    rows = table(spark, sf, "region").join(nations, "r_regionkey").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), F.to_json(one).alias("j")))).alias("s"))
    path = _json(rows.select(F.concat(F.lit('{"segments": ['), F.array_join("s.j", ", "), F.lit("]}")).alias("value")), scratch(spark, "segments"))
    return R.read_segments(spark, path).select("position", "segment_id", "start_date", "end_date", F.col("type_distribution")["nations"].alias("n"))


@query("SELECT CAST(r_regionkey AS INTEGER) AS segment_id, '202' || r_regionkey || '-01-01' AS start_date, 'unknown' AS missing FROM region WHERE r_name = 'ASIA'")
def segment_info(spark, sf):
    year = F.concat(F.lit("202"), F.col("r_regionkey").cast("string"), F.lit("-01-01"))
    segments = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("segment_id"), year.alias("start_date"), year.alias("end_date"))
    asia = table(spark, sf, "region").where("r_name = 'ASIA'").first()["r_regionkey"]
    known, other = C.segment_info(spark, segments, int(asia)), C.segment_info(spark, segments, 99)
    return spark.createDataFrame([(known["segment_id"], known["start_date"], other["start_date"])], "segment_id int, start_date string, missing string")


@query("SELECT n_nationkey, 'txt' AS file_type, CAST(length(n_name) + 1 AS BIGINT) AS file_size, n_name AS text FROM nation")
def source_files_scan(spark, sf):
    path = scratch(spark, "sources")
    table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    table(spark, sf, "nation").select("n_name").write.csv(f"{path}/csv")  # not one of the kinds that are read
    return R.read_source_files(spark, path).select(F.regexp_extract("file_path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), "file_type", "file_size", "text")


# corpora


def _chunks(spark, sf):
    segment = F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("doc_id") % 4).cast("int")
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("text").alias("contents"), segment.alias("segment_id"), F.array("lang").alias("entities"), F.lit("2024-01-01").alias("extracted_date"), F.col("lang").alias("game_name"))


def _written(spark, sf, by_game=False):
    path = scratch(spark, "corpus")
    W.write_corpus(_chunks(spark, sf) if by_game else _chunks(spark, sf).drop("game_name"), path)
    return path


@query(f"SELECT 'd' || doc_id AS id, source AS title, CASE WHEN doc_id % 4 = 0 THEN 'timeless' ELSE CAST({_SEGMENT} AS VARCHAR) END AS segment_key, md5(coalesce(text, '')) AS md5 FROM documents")
def corpus_scan(spark, sf):
    return R.read_corpus(spark, _written(spark, sf)).select("id", "title", "segment_key", F.md5("text").alias("md5"))


@query(f"SELECT 'd' || doc_id AS id, CAST({_SEGMENT} AS INTEGER) AS segment_id, lang AS entity FROM documents WHERE {_SEGMENT} IN (-1, 2)")
def corpus_scan_segment(spark, sf):
    """The chunks of a segment and the timeless ones."""
    return R.read_corpus(spark, _written(spark, sf), 2).select("id", "segment_id", F.col("entities")[0].alias("entity"))


@query(f"SELECT lang AS game_name, CASE WHEN doc_id % 4 = 0 THEN 'timeless' ELSE CAST({_SEGMENT} AS VARCHAR) END AS segment_key, count(*) AS n FROM documents GROUP BY ALL")
def corpus_scan_games(spark, sf):
    """A corpus of several games, by game and segment."""
    return R.read_corpus(spark, _written(spark, sf, True)).groupBy("game_name", "segment_key").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 'timeless' ELSE CAST({_SEGMENT} AS VARCHAR) END AS segment_key FROM documents")
def segment_discovery(spark, sf):
    return R.available_segments(spark, _written(spark, sf))


@query("SELECT DISTINCT lang AS game_name FROM documents")
def available_games(spark, sf):
    return R.available_games(table(spark, sf, "documents").select(F.col("lang").alias("game_name")))


# questions and answers


def _qa(spark, sf):
    return _pairs(spark, sf).select("question", "answer", F.col("turn").cast("int").alias("segment_id"), F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("game_name"))


@query(f"SELECT md5(question) AS question, md5(answer) AS answer, CAST(turn AS INTEGER) AS segment_id, 'g' || conv_id AS game_name FROM {_PAIRS}")
def qa_jsonl_roundtrip(spark, sf):
    path = scratch(spark, "qa")
    W.write_qa(_qa(spark, sf), path)
    return R.read_qa(spark, path).select(F.md5("question").alias("question"), F.md5("answer").alias("answer"), "segment_id", "game_name")


@query(f"SELECT 'g' || conv_id AS game_name, md5(question) AS question FROM {_PAIRS} WHERE length(question) % 3 > 0")
def qa_jsonl_required(spark, sf):
    """Blank questions and broken lines are no pairs."""
    q = F.when(F.length("question") % 3 > 0, F.col("question")).otherwise("  ")
    rows = _qa(spark, sf).withColumn("question", q)
    lines = rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit('{"question": "cut'), F.lit(""))).alias("value"))
    return R.read_qa(spark, _json(lines, scratch(spark, "qa")), required=True).select("game_name", F.md5("question").alias("question"))


@query("SELECT 'g' || item_id AS game_name, md5(text) AS question, CAST(item_id AS VARCHAR) AS reference, item_id / 2.0 AS score, 0 AS n_entities FROM benchmark")
def qa_csv_scan(spark, sf):
    i = F.col("item_id").cast("string")
    docs = F.to_json(F.array(F.struct(i.alias("id"), (F.col("item_id") / 2.0).alias("score"))))
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("g"), i).alias("game_name"), F.col("text").alias("question"), F.lit('say "yes"').alias("answer"), F.lit("t").alias("question_topic"), F.lit("f").alias("task_type"), F.lit("2024").alias("time"), F.to_json(F.array(i)).alias("references"), docs.alias("retrieved_docs"), F.lit("not a list").alias("entities"))
    path = scratch(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return R.read_qa_csv(spark, path).select("game_name", F.md5("question").alias("question"), F.col("references")[0].alias("reference"), F.col("retrieved_docs")[0]["score"].alias("score"), F.size("entities").alias("n_entities"))


# templates, personas, taxonomies


@query("SELECT 't' || item_id AS id, md5(text) AS template, 'x' AS topic, 1 AS n FROM benchmark")
def templates_scan(spark, sf):
    """Broken lines are skipped."""
    one = F.struct(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("template"), F.lit("x").alias("topic"), F.array(F.lit("p")).alias("placeholders"))
    lines = table(spark, sf, "benchmark").select(F.explode(F.array(F.to_json(one), F.lit("broken {"))).alias("value"))
    return R.read_templates(spark, _json(lines, scratch(spark, "templates"))).select("id", F.md5("template").alias("template"), "topic", F.size("placeholders").alias("n"))


@query("SELECT 'c' || c_custkey AS player_description, c_mktsegment AS source_content, c_mktsegment || '|all' AS source_topic FROM customer")
def personas_scan(spark, sf):
    one = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("player_description"), F.col("c_mktsegment").alias("source_content"), F.concat("c_mktsegment", F.lit("|all")).alias("source_topic"))
    return R.read_personas(spark, _json(table(spark, sf, "customer").select(F.to_json(one).alias("value")), scratch(spark, "personas")))


_TAXONOMY = "SELECT r_name AS main, CAST(NULL AS VARCHAR) AS sub, 'R' || r_regionkey AS code FROM region UNION ALL SELECT r_name, n_name, 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_TAXONOMY)
def taxonomy_scan(spark, sf):
    named = lambda name, key: F.concat(F.lit(name), F.col(key).cast("string")).alias("code")
    sub = F.struct(named("N", "n_nationkey"), F.lit("d").alias("description"), F.array(F.lit("k")).alias("keywords"), F.array(F.lit("e")).alias("examples"))
    subs = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", sub))).alias("subcategories"))
    main = F.struct(named("R", "r_regionkey"), F.lit("m").alias("description"), "subcategories")
    whole = table(spark, sf, "region").join(subs, "r_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", main)))).alias("value"))  # one small file by nature
    return R.read_taxonomy(spark, _json(whole, scratch(spark, "taxonomy"))).select("main", "sub", "code")


@query("SELECT DISTINCT o_orderpriority AS task_type, 'do ' || o_orderpriority AS requirement FROM orders")
def task_types_scan(spark, sf):
    kinds = table(spark, sf, "orders").select("o_orderpriority").distinct()
    whole = kinds.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.concat(F.lit("do "), "o_orderpriority"))))).alias("value"))
    return R.read_task_types(spark, _json(whole, scratch(spark, "tasks")))


# results, metrics, boards, progress


@query("SELECT CAST(item_id AS INTEGER) AS question_index, md5(text) AS question, 'd' || item_id AS doc_id, item_id / 4.0 AS score, CASE WHEN item_id % 9 = 0 THEN 'failed' END AS error FROM benchmark")
def retrieval_results_roundtrip(spark, sf):
    i = F.concat(F.lit("d"), F.col("item_id").cast("string"))
    docs = F.array(F.struct(i.alias("id"), F.lit("c").alias("content"), F.create_map(F.lit("id"), i).alias("metadata"), (F.col("item_id") / 4.0).alias("score")))
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("question_index"), F.col("text").alias("question"), docs.alias("retrieved_docs"), F.array(i).alias("retrieved_doc_ids"), F.when(F.col("item_id") % 9 == 0, "failed").alias("error"))
    path = scratch(spark, "retrieval")
    W.write_results(rows, path)
    return R.read_retrieval_results(spark, path).select("question_index", F.md5("question").alias("question"), F.col("retrieved_docs")[0]["metadata"]["id"].alias("doc_id"), F.col("retrieved_docs")[0]["score"].alias("score"), "error")


@query("SELECT CAST(conv_id AS INTEGER) AS question_index, CAST(turn AS VARCHAR) AS game_name, md5(text) AS answer, turn / 8.0 AS generation_time FROM conversations")
def generation_results_roundtrip(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("question_index"), F.col("turn").cast("string").alias("game_name"), F.col("text").alias("answer"), (F.col("turn") / 8.0).alias("generation_time"))
    path = scratch(spark, "generation")
    W.write_results(rows, path)
    return R.read_generation_results(spark, path).select("question_index", "game_name", F.md5("answer").alias("answer"), "generation_time")


@query("SELECT 'bm25_k' || l_linenumber AS model_key, l_returnflag, round(avg(l_quantity), 4) AS recall FROM lineitem GROUP BY ALL")
def metrics_by_model_roundtrip(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("bm25_k"), F.col("l_linenumber").cast("string")).alias("model_key"), "l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("recall"))
    path = scratch(spark, "metrics")
    W.write_metrics(rows, path, "model_key")
    return spark.read.schema("model_key string, l_returnflag string, recall double").json(path)


@query(f"SELECT system_name, game, topk, CAST(recall AS VARCHAR) AS recall FROM (SELECT system_name, game, topk, CAST(round(recall * 10000) AS BIGINT) AS recall FROM {_SQL_SUBMISSIONS})")
def submissions_scan(spark, sf):
    """One file a system; the recall in ten thousandths, since engines write doubles differently."""
    metrics = F.struct("topk", F.round(F.col("recall") * 10000).cast("long").cast("string").alias("recall"))
    rows = submissions(spark, sf).groupBy("system_name").agg(F.map_from_entries(F.collect_list(F.struct("game", metrics))).alias("games"))
    path = scratch(spark, "submissions")
    W.write_submissions(rows, path)
    return R.read_submissions(spark, path).select("system_name", "game", "topk", "recall")


@query(f"SELECT system_name, CAST(floor(total_score * 100) AS BIGINT) AS points, CAST(row_number() OVER (ORDER BY floor(total_score * 100) DESC, CAST(substr(system_name, 2) AS BIGINT), system_name) AS INTEGER) AS rank FROM ({_SQL_SCORED})")
def leaderboard_roundtrip(spark, sf):
    board = _scored(spark, sf).select(F.substring("system_name", 2, 20).cast("long").alias("seq"), "system_name", F.floor(F.col("total_score") * 100).cast("long").alias("total_score"))
    path = scratch(spark, "board")
    W.write_leaderboard(B.ranked(board), path)
    return R.read_leaderboard(spark, path, "system_name string, total_score long, rank int").select("system_name", F.col("total_score").alias("points"), "rank")


@query(f"{sql_top()} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_index_reused(spark, sf):
    """An index that is built, found current, read again and searched."""
    docs, root = table(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "index")
    I.load_or_build(docs, root)
    return I.search(I.load_or_build(docs, root), _items(spark, sf), 3).select("query_id", "doc_id", "score", "rank")


@query(f"SELECT query_id, vec_id, score, CASE WHEN vec_id % 2 = 0 THEN 'v' || vec_id ELSE 'Document ' || vec_id END AS content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_SQL_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE r <= 3")
def vector_store_reused(spark, sf):
    """Vectors kept under what they were made from, read again, searched, and looked up in a store that lacks some."""
    e, path = table(spark, sf, "embeddings"), scratch(spark, "vectors")
    items = e.select("vec_id", F.col("vec_id").cast("string").alias("text"))
    make = lambda rows: rows.join(e, "vec_id").select("vec_id", "embedding")
    V.load_or_embed(items, path, make)
    kept = V.load_or_embed(items, path, make)
    found = N.nearest(kept.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), kept, 3)
    store = e.where("vec_id % 2 = 0").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    return V.lookup(found, store, "vec_id", "text").select("query_id", "vec_id", "score", "content")


@query("SELECT lang AS segment, CAST(count(*) AS INTEGER) AS generated_count, 'now' AS last_updated FROM documents GROUP BY 1")
def progress_roundtrip(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").cast("int").alias("generated_count"))
    path = scratch(spark, "progress")
    W.write_progress(rows.select(F.array("k").alias("processed_template_ids"), "generated_count", F.lit("now").alias("last_updated")), path)
    return R.read_progress(spark, path).select(F.col("processed_template_ids")[0].alias("segment"), "generated_count", "last_updated")


@query(f"SELECT CAST(turn AS INTEGER) AS segment_id, count(*) AS n FROM {_PAIRS} WHERE turn <> 1 GROUP BY 1")
def outputs_reset(spark, sf):
    """The outputs of one segment are removed, those of the others stay."""
    path = scratch(spark, "qa")
    W.write_qa(_qa(spark, sf), path)
    W.delete(spark, f"{path}/segment=1")
    return R.read_qa(spark, path).groupBy("segment_id").agg(F.count("*").alias("n"))


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' | ' || n || ' |' AS line FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1) USING (r_regionkey)")
def markdown_lines(spark, sf):
    nations = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return W.markdown_report(table(spark, sf, "region").join(nations, "r_regionkey").select("r_regionkey", "r_name", "n"))


@query("SELECT 'Retrieval' AS line UNION ALL SELECT 'Generation' UNION ALL SELECT '  ' || l_returnflag || ': ' || printf('%.4f', count(*) / 8.0) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT '  ' || l_linestatus || ': 0.5000 (' || count(*) || '/' || count(*) || ')' FROM lineitem GROUP BY l_linestatus")
def summary_text(spark, sf):
    rows = table(spark, sf, "lineitem")
    first = rows.groupBy(F.col("l_returnflag").alias("metric")).agg((F.count("*") / 8.0).alias("value"))
    second = rows.groupBy(F.col("l_linestatus").alias("metric")).agg(F.lit(0.5).alias("value"), F.count("*").alias("counted"), F.count("*").alias("total"))
    return W.summary_report(first, second).select("line")


@query("SELECT event_id, round(seconds / n, 6) AS retrieval_time FROM events, (SELECT sum(CAST(round(value * 100) AS BIGINT)) / 100 AS seconds, count(*) AS n FROM events)")
def mean_retrieval_time(spark, sf):
    """The seconds of a batch over its rows, beside each of them."""
    rows = table(spark, sf, "events")
    seconds = rows.agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s")).first()["s"] / 100
    return with_mean_time(rows.select("event_id"), seconds).select("event_id", F.round("retrieval_time", 6).alias("retrieval_time"))


@query("SELECT 'bm25' AS retriever, 3 AS k, 'bm25_k3' AS model_key, 0.75 AS b")
def configuration_row(spark, sf):
    c = C.load(C.RetrievalConfig, '{"k": 3, "unknown": true}')
    return spark.range(1).select(C.as_column(c).alias("c"), F.lit(c.model_key).alias("model_key")).select("c.retriever", "c.k", "model_key", "c.b")
