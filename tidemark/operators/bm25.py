"""BM25 over an inverted index in tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import Segmenter, tokens

K1, B = 1.2, 0.75
#: Distinct query tokens up to which postings are pruned by a broadcast.
MAX_BROADCAST_TOKENS = 1_000_000
DIGITS = 4
#: Scores that a task works on at a time.
_TOGETHER = 1 << 20


def _scope(df: DataFrame, scope: str | None):
    return df[scope].cast("string") if scope else F.lit("all")


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str | None = None, segment: Segmenter | None = None) -> DataFrame:
    """(scope, doc_id, tokens, dl); null texts have no tokens."""
    words = F.coalesce(tokens(F.col(text), segment), F.array().cast("array<string>"))
    return docs.select(_scope(docs, scope).alias("scope"), F.col(doc_id).alias("doc_id"), words.alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(scope, doc_id, dl, token, tf) of tokenized documents."""
    return docs.select("scope", "doc_id", "dl", F.explode("tokens").alias("token")).groupBy("scope", "doc_id", "dl", "token").agg(F.count("*").alias("tf"))


def idf(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, token, df, idf), unsmoothed: 0 for a token in every document."""
    df = posted.groupBy("scope", "token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(stats.select("scope", "n_docs")), "scope").select("scope", "token", "df", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(scope, n_docs, avgdl): one row for each scope."""
    return docs.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_tokens(queries: DataFrame, query_id: str = "query_id", text: str = "text", scope: str | None = None, segment: Segmenter | None = None) -> DataFrame:
    """(scope, query_id, token, qtf): repeats in a query count."""
    out = queries.select(_scope(queries, scope).alias("scope"), F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text), segment)).alias("token"))
    return out.groupBy("scope", "query_id", "token").agg(F.count("*").alias("qtf"))


def score(docs: DataFrame, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(scope, query_id, doc_id, score) of the documents that share a token with a query of their scope.

    One pass over the documents and one shuffle of their hits: tokens that no query has are dropped before it,
    by a broadcast of the queries' vocabulary where that is small enough. The statistics and the weights are
    aggregates of the same shuffled hits, in which every document also has one row with an empty token. Scores
    are rounded, so that ties are ties whatever the order of summing.
    """
    small = _is_small(asked)
    vocabulary = asked.select("scope", "token").distinct().withColumn("known", F.lit(True))
    rows = docs.where("scope is not null").select("scope", "doc_id", "dl", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token")).where("token is not null")
    rows = rows.join(F.broadcast(vocabulary) if small else vocabulary, ["scope", "token"], "left").where("known or token = ''")
    hits = rows.groupBy("scope", "token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    # every branch reads tf and filters nothing below the aggregation, so that its shuffle is one and the same
    some = F.col("tf") > 0
    stats = hits.groupBy("scope").agg(F.count_if(some & (F.col("token") == "")).alias("n_docs"), F.avg(F.when(some & (F.col("token") == ""), F.col("dl"))).alias("avgdl"))
    df = hits.groupBy("scope", "token").agg(F.count_if(some).alias("df"))
    weights = df.join(F.broadcast(stats), "scope").select("scope", "token", "avgdl", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    return _summed(hits, asked.join(weights, ["scope", "token"]), small, k1, b)


def _summed(hits: DataFrame, weighted: DataFrame, small: bool, k1: float, b: float) -> DataFrame:
    """Scores of hits (scope, token, doc_id, dl, tf) under the queries' tokens with idf and avgdl."""
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = hits.join(F.broadcast(weighted) if small else weighted, ["scope", "token"])
    return found.groupBy("scope", "query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * part), DIGITS).alias("score"))


def _is_small(asked: DataFrame) -> bool:
    return asked.limit(MAX_BROADCAST_TOKENS + 1).count() <= MAX_BROADCAST_TOKENS


def score_postings(posted: DataFrame, stats: DataFrame, weights: DataFrame, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The same from an index: postings, statistics and weights, as built or as read again."""
    weighted = asked.join(weights, ["scope", "token"]).join(F.broadcast(stats.select("scope", "avgdl")), "scope")
    return _summed(posted, weighted, _is_small(asked), k1, b)


def top_k(scored: DataFrame, k: int = 3) -> DataFrame:
    """With ``rank`` up to ``k``: score descending, then the larger doc_id."""
    rank = F.row_number().over(Window.partitionBy("scope", "query_id").orderBy(F.desc("score"), F.desc("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def pad(top: DataFrame, docs: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """``top`` filled up to ``k`` for queries with any token: documents without a score come after, the larger id first.

    No query needs more than the ``2 k`` largest ids of its scope, since at most ``k`` of them are in its list.
    """
    largest = docs.select("scope", "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("doc_id")))).where(F.col("r") <= 2 * k).drop("r")
    some = asked.select("scope", "query_id").distinct().join(F.broadcast(largest), "scope")
    fill = some.join(top.select("scope", "query_id", "doc_id"), ["scope", "query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(top.drop("rank").unionByName(fill), k)


def _rounded(raw: np.ndarray) -> np.ndarray:
    """As Spark rounds: halves of the decimal that is written for a double go up."""
    scaled = raw * 10.0**DIGITS
    out = np.floor(scaled + 0.5) / 10.0**DIGITS
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + 1e-12 * scaled):
        out[i] = float(Decimal(repr(float(raw[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


class _Best:
    """The ``k`` best documents so far of each query of a scope; ``weighted`` has its queries' tokens (query_id, token, qtf, idf, avgdl)."""

    def __init__(self, weighted: pa.Table, k: int, k1: float, b: float):
        code = lambda c: weighted[c].combine_chunks().dictionary_encode()
        token, asked = code("token"), code("query_id")
        at = np.asarray(token.indices)
        order = np.argsort(at, kind="stable")
        self.vocabulary, self.queries = token.dictionary, asked.dictionary
        self.of = np.asarray(asked.indices.fill_null(len(asked.dictionary)))[order].astype(np.int64)
        self.n = len(self.queries) + (asked.null_count > 0)
        self.times = weighted["qtf"].to_numpy()[order].astype(float)
        self.begin = np.append(0, np.cumsum(np.bincount(at, minlength=len(self.vocabulary))))
        self.idf = weighted["idf"].to_numpy()[order][self.begin[:-1]]
        self.avgdl, self.k, self.k1, self.b = weighted["avgdl"][0].as_py(), k, k1, b
        self.least = np.full(self.n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, ids: pa.Array, lists: pa.Array, dl: np.ndarray) -> None:
        """Score documents by their lists of tokens."""
        found = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        there = np.asarray(found.is_valid())
        rows = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(lists).fill_null(0)))[there]
        wide = len(self.vocabulary)
        cell, tf = np.unique(rows * wide + np.asarray(found.drop_null()).astype(np.int64), return_counts=True)
        row, token = cell // wide, cell % wide
        part = self.idf[token] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[row] / self.avgdl))
        times = self.begin[token + 1] - self.begin[token]
        cost = np.bincount(row, times, minlength=len(ids)) + self.n
        turn = (np.cumsum(cost) - cost) // _TOGETHER  # of each document
        cuts = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(ids))
        for lo, hi in zip(cuts, cuts[1:]):
            own = slice(*np.searchsorted(row, [lo, hi]))
            n = times[own]
            at = np.repeat(self.begin[token[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cells = np.repeat(row[own] - lo, n) * self.n + self.of[at]
            total = np.bincount(cells, np.repeat(part[own], n) * self.times[at], minlength=1)
            met = np.flatnonzero(np.bincount(cells, minlength=1))
            query, raw = met % self.n, total[met]
            near = raw >= self.least[query] - 2 * 10.0**-DIGITS
            met, query, score = met[near], query[near], _rounded(raw[near])
            near = score >= self.least[query]
            self.held.append((query[near], score[near], ids.take(pa.array(met[near] // self.n + lo))))
            self.size += int(near.sum())
            if self.size > max(_TOGETHER // 4, 2 * self.k * self.n):
                self.trim()

    def trim(self) -> None:
        """Leave the ``k`` best of each query: score descending, then the larger id."""
        if not self.held:
            return
        query, score = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.held])
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.sort_indices(ids, sort_keys=[("", "descending")]))] = np.arange(len(ids))
        order = np.lexsort((place, -score, query))
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < self.k]
        query, score = query[order], score[order]
        full = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.least[query[full]] = score[full]
        self.held, self.size = [(query, score, ids.take(pa.array(order)))], len(order)

    def rows(self, scope: str) -> Iterator[pa.RecordBatch]:
        self.trim()
        for query, score, ids in self.held:
            asked = self.queries.take(pa.array(query, mask=query == len(self.queries)))
            yield pa.RecordBatch.from_arrays([pa.array([scope] * len(ids), pa.string()), asked, ids, pa.array(score)], ["scope", "query_id", "doc_id", "score"])


def _best(shared, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, found = shared.value, {}
        scopes = weighted["scope"].unique().to_pylist()
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            for i, scope in enumerate(code.dictionary.to_pylist()):
                if scope not in found:
                    found[scope] = _Best(weighted.filter(pc.equal(weighted["scope"], scope)), k, k1, b) if scope in scopes else None
                if found[scope] is not None:
                    own = batch.filter(pc.equal(code.indices, i)) if len(code.dictionary) > 1 else batch
                    found[scope].add(own.column(1), own.column(2), own.column(3).to_numpy())
        for scope, own in found.items():
            if own is not None:
                yield from own.rows(scope)

    return run


def best(docs: DataFrame, asked: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(scope, query_id, doc_id, score): at least the ``k`` best documents of each query, where a document is one row of tokens.

    The first pass over ``docs`` counts the documents of the queries' tokens. In the second one each document is scored where
    it is read, and a task hands on its ``k`` best of each query: neither hits nor scores are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.where("scope is not null")
    vocabulary = asked.select("scope", "token").distinct().withColumn("known", F.lit(True))
    tokens_of = rows.select("scope", "dl", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "tokens"))).alias("token"))
    tokens_of = tokens_of.join(F.broadcast(vocabulary), ["scope", "token"], "left").where("known or token = ''")
    df = tokens_of.groupBy("scope", "token").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")).toArrow()  # a row a token of the queries, and one a scope
    df = spark.createDataFrame(df)
    stats = df.where("token = ''").select("scope", F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avgdl"))
    weights = df.where("token <> ''").join(F.broadcast(stats), "scope").select("scope", "token", "avgdl", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    shared = spark.sparkContext.broadcast(asked.join(F.broadcast(weights), ["scope", "token"]).select("scope", "query_id", "token", "qtf", "idf", "avgdl").toArrow())  # MAX_BROADCAST_TOKENS rows at most
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((asked, "query_id"), (docs, "doc_id"))]
    return rows.select("scope", "doc_id", "tokens", "dl").mapInArrow(_best(shared, k, k1, b), f"scope string, query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def retrieve(docs: DataFrame, queries: DataFrame, k: int = 3, scope: str | None = None, padded: bool = False, segment: Segmenter | None = None) -> DataFrame:
    """(scope, query_id, doc_id, score, rank) for ``docs`` (doc_id, text) and ``queries`` (query_id, text).

    Rows that repeat an id of their scope are one document, for which hits have to be shuffled; so have they for more query
    tokens than tasks can be given.
    """
    index, asked = tokenized(docs, scope=scope, segment=segment), query_tokens(queries, scope=scope, segment=segment)
    local = _is_small(asked) and docs.select(_scope(docs, scope).alias("scope"), "doc_id").groupBy("scope", "doc_id").count().where("count > 1").isEmpty()
    top = top_k(best(index, asked, k) if local else score(index, asked), k)
    return pad(top, index, asked, k) if padded else top
