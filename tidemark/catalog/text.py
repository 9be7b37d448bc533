"""Cleaning, chunking, entities and fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.registry import query, table
from tidemark.functions import text as X
from tidemark.operators import entities as E

def _sql_html(column: str) -> str:
    out = column
    for pattern, to in X.MARKUP:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    for name, char in X._ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


def _sql_space(column: str) -> str:
    fewer = f"regexp_replace({column}, '\\n{{3,}}', '\n\n', 'g')"
    lines = f"array_to_string(list_transform(string_split({fewer}, '\n'), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), '\n')"
    return f"regexp_replace(regexp_replace({lines}, '[ \\t]+', ' ', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


_LINKED = "concat('see [', source, '](http://x.org/', doc_id, ') and ', text)"
_SQL_LINKED = "'see [' || source || '](http://x.org/' || doc_id || ') and ' || coalesce(text, '')"


def _linked():
    return F.concat(F.lit("see ["), "source", F.lit("](http://x.org/"), F.col("doc_id").cast("string"), F.lit(") and "), F.coalesce("text", F.lit("")))


@query(f"SELECT doc_id, md5(regexp_replace({_SQL_LINKED}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')) AS md5 FROM documents")
def md_links_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.strip_md_links(_linked())).alias("md5"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, '') || ' [' || doc_id || '] end [x1]', '\\[[0-9]+\\]', '', 'g')) AS md5 FROM documents")
def citation_strip(spark, sf):
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("doc_id").cast("string"), F.lit("] end [x1]"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.strip_citations(cited)).alias("md5"))


@query(f"SELECT doc_id, md5({_sql_space('text')}) AS md5, length({_sql_space('text')}) AS n_chars FROM documents")
def whitespace_normalize(spark, sf):
    out = X.normalize_whitespace(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(out).alias("md5"), F.length(out).cast("long").alias("n_chars"))


@query(f"SELECT page_id, md5({_sql_space(_sql_html('html'))}) AS md5 FROM pages")
def html_text_regex(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.normalize_whitespace(X.html_text(F.col("html")))).alias("md5"))


@query()
def html_text_parsed(spark, sf):
    from tidemark.functions.html import parsed_text

    return parsed_text(table(spark, sf, "pages"), "html").select("page_id", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT page_id, (length(html) - length({_sql_space(_sql_html('html'))})) > 0.1 * length(html) AS shrunk FROM pages")
def html_shrink_flag(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.shrunk(F.col("html"), X.normalize_whitespace(X.html_text(F.col("html")))).alias("shrunk"))


@query("SELECT doc_id FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def blank_doc_filter(spark, sf):
    from tidemark.operators.qa import drop_blank

    return drop_blank(table(spark, sf, "documents")).select("doc_id")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 100) / 80.0) AS BIGINT)))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS i, md5(array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ')) AS md5 FROM n""")
def chunk_overlap(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), 100, 20)).alias("c"))
    return rows.select("doc_id", "c.i", F.md5("c.contents").alias("md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN 3003 ELSE length(text) END AS n_chars, md5(CASE WHEN length(text) > 3000 THEN text[:3000] || '...' ELSE text END) AS md5 FROM documents")
def ner_text_cap(spark, sf):
    capped = X.cap(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(capped).cast("long").alias("n_chars"), F.md5(capped).alias("md5"))


_SQL_ENTITIES = "list_distinct(regexp_extract_all(coalesce(text, ''), '(\\p{Lu}\\p{Ll}{2,}(?: \\p{Lu}\\p{Ll}{2,})*)', 1))"


@query(f"SELECT doc_id, len({_SQL_ENTITIES}) AS n, md5(array_to_string(list_sort({_SQL_ENTITIES}), '|')) AS md5 FROM documents")
def entity_extract_rule(spark, sf):
    found = E.extract_capitalized(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(found), "|")).alias("md5"))


def _chunked(spark, sf):
    segment = (F.col("doc_id") % 4 - F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).cast("int")
    return table(spark, sf, "documents").select("doc_id", segment.alias("segment_id"), E.extract_capitalized(F.col("text")).alias("entities"))


_SQL_CHUNKED = f"(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 4 END AS segment_id, {_SQL_ENTITIES} AS entities FROM documents)"


@query(f"""SELECT count(*) AS total_chunks, CAST(sum(len(entities)) AS BIGINT) AS total_entities,
(SELECT count(DISTINCT lower(trim(e))) FROM (SELECT unnest(entities) AS e FROM {_SQL_CHUNKED}) WHERE trim(e) <> '') AS unique_entities,
count(*) FILTER (len(entities) > 0) AS chunks_with_entities FROM {_SQL_CHUNKED}""")
def entity_stats(spark, sf):
    return E.statistics(_chunked(spark, sf))


@query(f"SELECT DISTINCT CAST(segment_id AS INTEGER) AS segment_id, trim(e) AS entity FROM (SELECT segment_id, unnest(entities) AS e FROM {_SQL_CHUNKED} WHERE segment_id > 0) WHERE trim(e) <> ''")
def segment_entities(spark, sf):
    return E.segment_entities(_chunked(spark, sf))


@query(f"""WITH c AS {_SQL_CHUNKED}, cur AS (SELECT DISTINCT unnest({_SQL_ENTITIES}) AS e FROM benchmark),
qa AS (SELECT doc_id AS qa_id, unnest(entities) AS e FROM c)
SELECT doc_id AS qa_id FROM c WHERE doc_id NOT IN (SELECT qa_id FROM qa WHERE e IN (SELECT e FROM cur))""")
def entity_overlap_discard(spark, sf):
    """All documents against the entities of the benchmark."""
    current = table(spark, sf, "benchmark").select(F.explode(E.extract_capitalized(F.col("text"))).alias("entity"))
    return E.discard_overlapping(_chunked(spark, sf).select(F.col("doc_id").alias("qa_id"), "entities"), current).select("qa_id")


@query(f"""WITH c AS {_SQL_CHUNKED}, p AS (SELECT doc_id, segment_id, unnest(entities) AS e FROM c),
n AS (SELECT DISTINCT CASE segment_id WHEN 1 THEN -1 WHEN -1 THEN 3 ELSE segment_id - 1 END AS segment_id, e FROM p)
SELECT doc_id AS qa_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM p JOIN n USING (segment_id, e))""")
def entity_overlap_discard_all(spark, sf):
    """The documents of each segment against the entities of the next; 1 follows the timeless, which follow 3."""
    c = _chunked(spark, sf)
    of = lambda segment: F.transform("entities", lambda e: F.concat(segment.cast("string"), F.lit("|"), e))
    after = F.when(F.col("segment_id") == -1, 1).when(F.col("segment_id") == 3, -1).otherwise(F.col("segment_id") + 1)
    current = c.select(F.explode(of(F.col("segment_id"))).alias("entity"))
    return E.discard_overlapping(c.select(F.col("doc_id").alias("qa_id"), of(after).alias("entities")), current).select("qa_id")


@query(f"""WITH e AS (SELECT DISTINCT unnest({_SQL_ENTITIES}) AS entity FROM benchmark)
SELECT item_id, count(*) AS n, min(entity) AS first_entity FROM benchmark JOIN e ON contains(lower(text), lower(entity)) GROUP BY item_id""")
def entity_mentions(spark, sf):
    items = table(spark, sf, "benchmark")
    known = items.select(F.explode(E.extract_capitalized(F.col("text"))).alias("entity"))
    return E.mentions(items, known, F.col("text"), "item_id").groupBy("item_id").agg(F.count("*").alias("n"), F.min("entity").alias("first_entity"))


@query("SELECT doc_id, array_to_string(list_distinct([x FOR x IN [trim(lang), ' ' || source, source, lang, ''] IF trim(x) <> '' AND x = trim(x)]).list_sort(), '|') AS entities FROM documents")
def entity_dedup_order(spark, sf):
    items = F.array(F.trim("lang"), F.concat(F.lit(" "), "source"), "source", "lang", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(E.dedup_in_order(items)), "|").alias("entities"))


@query("SELECT conv_id, turn, substr(md5('question: ' || question || chr(10) || 'answer: ' || answer), 1, 8) AS fingerprint FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def qa_fingerprint(spark, sf):
    from tidemark.operators.qa import next_answer

    return next_answer(table(spark, sf, "conversations")).select("conv_id", "turn", X.fingerprint(F.col("question"), F.col("answer")).alias("fingerprint"))


@query("SELECT conv_id, md5(string_agg('Document ' || k || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS md5 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3 GROUP BY conv_id")
def context_concat(spark, sf):
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))  # a top-k of each conversation
    turns = table(spark, sf, "conversations").withColumn("k", first).where("k <= 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
    return turns.select("conv_id", F.md5(X.numbered_context(F.col("t.text"))).alias("md5"))
