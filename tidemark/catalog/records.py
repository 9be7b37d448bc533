"""Records and prompts: projections of pairs and results, parsers of replies, contexts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.answers import _PAIRS, _pairs
from tidemark.catalog.registry import query, table
from tidemark.functions import html as H
from tidemark.functions import parsing as P
from tidemark.functions import text as X
from tidemark.operators import allocation as L
from tidemark.operators import entities as E
from tidemark.operators import evaluation as V
from tidemark.operators import qa as Q
from tidemark.operators import vector as D
from tidemark.operators.order import placed


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _case(*options):
    """The options in turn by doc_id."""
    return F.element_at(F.array(*options), (F.col("doc_id") % len(options) + 1).cast("int"))


# pairs and results


@query("SELECT doc_id, source || '|' || lang AS entities, 2 AS n_columns FROM documents")
def output_cleaning(spark, sf):
    """Entities distinct and in order; inner columns go."""
    rows = _docs(spark, sf).select("doc_id", F.array("source", F.lit(" "), F.concat(F.lit(" "), "lang"), "source").alias("entities"), F.lit("t").alias("template_id"), F.lit("s").alias("source_template"))
    out = Q.clean_output(rows)
    return out.select("doc_id", F.array_join("entities", "|").alias("entities"), F.lit(len(out.columns)).alias("n_columns"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang || '1' ELSE lang || '2' END AS contexts FROM documents")
def contexts_fallback(spark, sf):
    given = _case(F.array("source"), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    docs = F.array(F.struct(F.concat("lang", _case(F.lit("0"), F.lit("1"), F.lit("2"))).alias("content")))
    return _docs(spark, sf).select("doc_id", F.array_join(Q.contexts(given, docs), ",").alias("contexts"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE '' END AS answer FROM documents")
def answer_fallback(spark, sf):
    none = F.lit(None).cast("string")
    return _docs(spark, sf).select("doc_id", Q.answer_text(_case(F.col("lang"), none, none), _case(F.col("source"), F.col("source"), none)).alias("answer"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'o' || lang WHEN 1 THEN 'unknown' WHEN 2 THEN source WHEN 3 THEN lang ELSE 'unknown' END AS game_name FROM documents")
def game_name_by_presence(spark, sf):
    """A field that is there decides, even if it says nothing."""
    field = lambda text: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in text))
    docs = '"retrieved_docs": [{"metadata": {}}, {"metadata": {"game": "'
    rows = _case(
        field(['{"original_qa_data": {"game_name": "o', F.col("lang"), '"}, "game_name": "x"}']),
        field(['{"original_qa_data": {}, "game_name": "', F.col("lang"), '"}']),
        field(['{"game_name": "', F.col("source"), '", ' + docs + 'x"}}]}']),
        field(["{" + docs, F.col("lang"), '"}}]}']),
        F.lit('{"retrieved_docs": []}'),
    )
    return _docs(spark, sf).select("doc_id", Q.game_of(rows).alias("game_name"))


@query("SELECT CAST(r_regionkey AS INTEGER) AS segment_id, r_name FROM region WHERE r_regionkey = 2")
def segment_selection(spark, sf):
    return Q.select_segment(table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("segment_id"), "r_name"), 2)


@query(f"SELECT md5(question) AS question, md5(answer) AS ground_truth_answer, 'd' || turn || ',' AS ids, conv_id FROM {_PAIRS}")
def pair_projection(spark, sf):
    doc = lambda i: F.struct(i.alias("id"), F.lit("c").alias("content"))
    docs = F.array(doc(F.concat(F.lit("d"), F.col("turn").cast("string"))), doc(F.lit(None).cast("string")))
    out = Q.as_pairs(_pairs(spark, sf).withColumn("retrieved_docs", docs))
    return out.select(F.md5("question").alias("question"), F.md5("ground_truth_answer").alias("ground_truth_answer"), F.array_join("ground_truth_doc_ids", ",").alias("ids"), F.col("original_data.conv_id").alias("conv_id"))


@query("SELECT 'ground truth: no field answer' AS problem UNION ALL SELECT 'results: no rows'")
def evaluation_data_validation(spark, sf):
    pairs = _pairs(spark, sf)
    found = Q.validate_pairs(pairs.limit(0), pairs.drop("answer")) + Q.validate_pairs(pairs, pairs)
    return spark.createDataFrame([(x,) for x in found], "problem string")


@query(f"SELECT a.conv_id, a.turn, md5(a.question) AS question, length(b.answer) AS n FROM {_PAIRS} a JOIN {_PAIRS} b USING (conv_id, turn)")
def ordinal_zip(spark, sf):
    order = lambda column: _pairs(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("ordinal"), *column)
    return Q.zip_by_order(order(["conv_id", "turn", "question"]), order([F.length("answer").alias("n")]), "ordinal").select("conv_id", "turn", F.md5("question").alias("question"), "n")


@query("SELECT b.item_id, d.doc_id, d.lang AS game_name FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def pair_documents(spark, sf):
    """The documents of pairs by game and id, as in the corpus."""
    truth = table(spark, sf, "benchmark").select("item_id", F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("c").alias("content"))).alias("retrieved_docs"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    pairs = Q.as_pairs(truth).select(F.col("original_data.item_id").alias("item_id"), F.explode("ground_truth_doc_ids").alias("doc_id"))
    return pairs.withColumn("doc_id", F.col("doc_id").cast("long")).join(_docs(spark, sf).select("doc_id", F.col("lang").alias("game_name")), "doc_id").select("item_id", "doc_id", "game_name")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim('description: ' || lang || ' topic: ' || source) WHEN doc_id % 3 = 1 THEN 'description: ' || lang ELSE 'content: x topic: ' || source END AS persona, 'template: ' || lang || ' kind: k topic: ' || source AS template FROM documents")
def persona_texts(spark, sf):
    none, blank = F.lit(None).cast("string"), F.lit(" ")
    persona = D.persona_text(_case(F.col("lang"), F.col("lang"), none), _case(blank, none, F.lit("x")), _case(F.col("source"), F.lit(""), F.col("source")))
    return _docs(spark, sf).select("doc_id", persona.alias("persona"), D.template_text(F.col("lang"), F.lit("k"), none, F.col("source")).alias("template"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN lang ELSE '' END AS entities FROM documents")
def entity_forms(spark, sf):
    """All strings stay, all structs give their texts, a mixture gives none."""
    struct = lambda c: F.concat(F.lit('{"text": "'), c, F.lit('", "type": "T"}'))
    items = _case(F.array("lang", "source"), F.array(struct(F.col("lang")), F.lit('{"text": ""}')), F.array("lang", struct(F.col("source"))))
    return _docs(spark, sf).select("doc_id", F.array_join(E.normalize_forms(items), ",").alias("entities"))


# reports


@query("SELECT l_linenumber AS segment_id, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok, round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*), 2) AS success_percent, round(avg(l_discount), 6) AS recall FROM lineitem GROUP BY 1")
def run_report(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("segment_id"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"), F.col("l_discount").alias("recall"))
    return V.run_report(rows)


@query("SELECT (SELECT count(*) FROM documents) AS total_personas, (SELECT count(*) FROM (SELECT lang AS t FROM documents UNION SELECT source FROM documents) WHERE trim(t) <> '') AS total_topics")
def persona_statistics(spark, sf):
    return D.persona_statistics(_docs(spark, sf).select(F.concat_ws("|", "lang", F.concat(F.lit(" "), "source"), F.lit("")).alias("source_topic")))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars / (doc_id % 7) END AS rate FROM documents")
def generation_success_rate(spark, sf):
    return _docs(spark, sf).select("doc_id", V.success_rate(F.col("n_chars"), F.col("doc_id") % 7).alias("rate"))


@query("SELECT doc_id, (doc_id % 5) || '/' || (doc_id % 4) || ' (' || printf('%.1f', CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 100.0 * (doc_id % 5) / (doc_id % 4) END) || '%)' AS progress FROM documents")
def progress_text(spark, sf):
    return _docs(spark, sf).select("doc_id", X.progress(F.col("doc_id") % 5, F.col("doc_id") % 4).alias("progress"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 25")
def test_mode_sample(spark, sf):
    """The cap of the test mode, which is what this operator is."""
    return L.test_sample(_docs(spark, sf).select("doc_id"), "doc_id", 25)


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS position FROM benchmark")
def input_order(spark, sf):
    """Rows that went through in any order, put back by their index."""
    rows = table(spark, sf, "benchmark").select("item_id").repartition(7).sortWithinPartitions(F.desc("item_id"))
    return placed(rows, F.col("item_id"), "position", 0)


@query("SELECT doc_id, lang AS part FROM documents UNION ALL SELECT doc_id, 'label' FROM labels")
def union_by_name(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("lang").alias("part")).unionByName(table(spark, sf, "labels").select(F.lit("label").alias("part"), "doc_id"))


# parsers of replies


@query("SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN '' ELSE lang || ':P' END AS entities FROM documents")
def entity_reply_ladder(spark, sf):
    """The whole as JSON, a fence, the braces, a bare list, nothing."""
    listed = F.concat(F.lit('"entities": [{"text": "'), "lang", F.lit('", "type": "P"}]'))
    whole = F.concat(F.lit("{"), listed, F.lit("}"))
    reply = _case(whole, F.concat(F.lit("x\n```json\n"), whole, F.lit("\n``` y")), F.concat(F.lit("so "), whole, F.lit(" end")), F.concat(F.lit("cut: "), listed, F.lit(", oh")), F.lit("none"))
    found = F.transform(P.entity_list(reply), lambda e: F.concat_ws(":", e["text"], e["type"]))
    return _docs(spark, sf).select("doc_id", F.array_join(found, ",").alias("entities"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'just ' || lang ELSE 'T ' || lang END AS template, CASE doc_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'lines' ELSE 'fallback' END AS method FROM documents")
def template_reply(spark, sf):
    reply = _case(F.concat(F.lit('{"template": "T '), "lang", F.lit('", "description": "d"}')), F.concat(F.lit("well\nTemplate: T "), "lang"), F.concat(F.lit("just "), "lang"))
    return _docs(spark, sf).withColumn("r", P.template_record(reply)).select("doc_id", "r.template", "r.method")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T ' || lang || ',U' WHEN 1 THEN 'Q ' || lang WHEN 2 THEN 'cut ' || lang ELSE '' END AS templates, CASE doc_id % 4 WHEN 0 THEN 'templates' WHEN 1 THEN 'pair' WHEN 2 THEN 'pattern' ELSE '' END AS method FROM documents")
def template_reply_alternatives(spark, sf):
    reply = _case(
        F.concat(F.lit('so {"templates": [{"template": "T '), "lang", F.lit('", "placeholders": ["p"]}, {"template": "U"}]} end')),
        F.concat(F.lit('```json\n{"question": "Q '), "lang", F.lit('", "answer": "A...')),
        F.concat(F.lit('it was "question": "cut '), "lang", F.lit('", and so on')),
        F.lit("nothing"),
    )
    rows = _docs(spark, sf).withColumn("r", P.template_list(reply))
    return rows.select("doc_id", F.array_join("r.template", ",").alias("templates"), F.coalesce(F.get("r.method", F.lit(0)), F.lit("")).alias("method"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'Is it ' || lang || '?' ELSE 'Q ' || lang END AS question, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'A' END AS answer, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'lines' WHEN 2 THEN 'heuristic' ELSE 'none' END AS method FROM documents")
def qa_reply(spark, sf):
    reply = _case(F.concat(F.lit('{"question": "Q '), "lang", F.lit('", "answer": "A"}')), F.concat(F.lit("Question: Q "), "lang", F.lit("\nAnswer: A")), F.concat(F.lit("Is it "), "lang", F.lit("?\nA")), F.lit("no"))
    return _docs(spark, sf).withColumn("r", P.qa_record(reply)).select("doc_id", "r.question", "r.answer", "r.method")


@query("SELECT doc_id, lang || '\n' || source AS body FROM documents")
def fence_strip(spark, sf):
    body = F.concat("lang", F.lit("\n"), "source")
    reply = _case(F.concat(F.lit(" ```json\n"), body, F.lit("\n```  ")), body, F.concat(F.lit("```\n"), body, F.lit("```")))
    return _docs(spark, sf).select("doc_id", P.strip_fence(reply).alias("body"))


# contexts of prompts


@query("SELECT conv_id, md5(string_agg('Document ' || k || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY k) FILTER (k <= 3)) AS answer_prompt, md5(string_agg(text, chr(10) ORDER BY k)) AS judge_contexts FROM (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def prompt_contexts(spark, sf):
    """The first three documents for an answer, all of them for a judge."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return turns.select("conv_id", F.md5(X.numbered_context(F.slice("t.text", 1, 3))).alias("answer_prompt"), F.md5(F.array_join("t.text", "\n")).alias("judge_contexts"))


_ROLE = "Speak as this person, in their words and with their interests, and name concrete details:"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{_ROLE}' || chr(10) || lang ELSE '' END AS role, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Follow the shape of this template, in other words.' || chr(10) || 'Template: ' || source || CASE WHEN doc_id % 3 = 1 THEN chr(10) || 'Meaning: ' || lang || chr(10) || 'Fill in: a, b' ELSE '' END END AS template FROM documents")
def role_and_template_contexts(spark, sf):
    none = F.lit(None).cast("string")
    shape = X.template_context(_case(F.lit(""), F.col("source"), F.col("source")), _case(none, F.col("lang"), none), _case(F.array(F.lit("x")), F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>")))
    return _docs(spark, sf).select("doc_id", X.role_context(_case(F.concat(F.lit(" "), "lang"), F.lit(" "))).alias("role"), shape.alias("template"))


@query("SELECT doc_id, lang || ' éé&' || chr(10) || source || ' 2' AS text FROM documents")
def html_text_full(spark, sf):
    """Markup in either case, every kind of reference, script content and citations, as the parser takes them."""
    markup = F.concat(F.lit("<P>"), "lang", F.lit(" &eacute;&#233;&amp;</P><SCRIPT>x < 1</SCRIPT><Table><tr><td>"), "source", F.lit("</td><td>2</td></tr></table>[1]"))
    return H.parsed_text(_docs(spark, sf).select("doc_id", markup.alias("markup")), "markup").select("doc_id", "text")
