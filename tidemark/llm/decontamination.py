"""Benchmark decontamination with a broadcast hash set of test n-grams, in DataFrame functions only.

Texts are split into words once, and the hash of every window of words is looked up in a broadcast set of the hashes of
the benchmark's windows. The few that meet are held against the windows themselves, word by word, and only then the
items that have a window come in, so that no row carries a list of items. Documents are read once, whatever the size
of the benchmark, and aren't shuffled: what leaves a task is a row for each document and its likely spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

WINDOW = 13
#: Share of a document's words, as 1 / MIN_SHARE, from which it counts as contaminated.
MIN_SHARE = 20
#: Hashes of windows up to which they are broadcast (16 bytes each); those of a larger benchmark are met in a shuffled join.
BROADCAST_WINDOWS = 1_000_000
#: Windows and bytes of windows up to which likely hits are held against a broadcast of them.
VERIFY_WINDOWS, VERIFY_BYTES = 100_000, 32 << 20
#: Documents to remove up to which their keys are broadcast; more are met in a shuffled join.
BROADCAST_IDS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    """The words, A-Z in lower case; other letters stay as they are."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, h, size, gram) of the benchmark's windows; an item of fewer words is one window."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words("text").alias("w")).where("item_id is not null and size(w) > 0")
    rows = rows.select("item_id", F.explode(F.expr(f"element_at(transform(array(w), v -> transform(sequence(1, greatest(1, size(v) - {window - 1})), p -> slice(v, p, {window}))), 1)")).alias("words"))
    return rows.select("item_id", F.expr("xxhash64(transform(words, x -> xxhash64(x)))").alias("h"), F.size("words").alias("size"), F.array_join("words", " ").alias("gram"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What of ``benchmark`` (item_id, text) occurs in ``docs`` (doc_id, text), and which items have it.

    The first table (doc_id, key, n_words, at, size, window_id), ``key`` being a hash of the text, has a row for each
    occurrence of a window, ``at`` counting words from 1, and one whose ``at`` is null for each document. The
    second one is (window_id, item_id).
    """
    grams = materialize(_items(benchmark, window), "grams")
    windows = materialize(grams.select("h", "size", "gram").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    owners = materialize(grams.join(windows, ["h", "size", "gram"]).select("window_id", "item_id").distinct(), "owners")
    stated = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("gram")).alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # ``window`` sizes at most
    sizes = stated["sizes"]
    rows = docs.select("doc_id", _key().alias("key"), _words("text").alias("w"))
    # a null for the document itself, then, word by word, the hashes of the windows of each size that start there
    m, listed = len(sizes), ", ".join(map(str, sizes))
    window_at = f"xxhash64(slice(hw, cast(p div {m} as int) + 1, element_at(array({listed}), cast(p % {m} as int) + 1)))" if m else ""
    each = f"if(size(hw) = 0, cast(array() as array<bigint>), transform(sequence(0, size(hw) * {m} - 1), p -> {window_at}))" if m else "cast(array() as array<bigint>)"
    # the words' hashes are a variable, since a slice of a row's column copies the whole of it
    hashes = F.expr(f"element_at(transform(array(transform(w, x -> xxhash64(x))), hw -> {each}), 1)")
    # the windows are a column before they are rows: lambdas are no part of generated code, and the words aren't copied for each window
    rows = rows.select("doc_id", "key", F.size("w").alias("n_words"), "w", F.concat(F.array(F.lit(None).cast("long")), hashes).alias("hashes"))
    rows = rows.select("doc_id", "key", "n_words", "w", F.posexplode_outer("hashes").alias("pos", "h"))
    known = windows.select(F.col("h").alias("known")).distinct()
    known = F.broadcast(known) if stated["n"] <= BROADCAST_WINDOWS else known
    at = F.floor((F.col("pos") - 1) / F.lit(max(m, 1))).cast("int") + 1
    size = F.element_at(F.array(*map(F.lit, sizes)), F.pmod(F.col("pos") - 1, F.lit(m)) + 1) if m else F.lit(None).cast("int")
    gram = F.when(F.col("known").isNotNull(), F.array_join(F.slice("w", at, size), " "))
    likely = rows.join(known, F.col("h") == F.col("known"), "left").where("known is not null or pos = 0")
    likely = likely.select("doc_id", "key", "n_words", "pos", F.when(F.col("known").isNotNull(), at).alias("at"), F.when(F.col("known").isNotNull(), size).alias("size"), F.col("h"), gram.alias("gram"))
    small = stated["n"] <= VERIFY_WINDOWS and (stated["bytes"] or 0) <= VERIFY_BYTES
    found = likely.join(F.broadcast(windows) if small else windows, ["h", "size", "gram"], "left").where("window_id is not null or pos = 0")
    return found.select("doc_id", "key", "n_words", F.when(F.col("window_id").isNotNull(), F.col("at")).alias("at"), "size", "window_id"), owners


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of any item; ``items`` lists the ids as text, in
    order. All other characters than A-Z stay as they are, in whatever case. A null text has no words; a benchmark that is empty hits nothing; repeated rows are each returned,
    rows that share a doc_id are judged by their own texts; items with a null id are left out; other columns
    are ignored.
    """
    found, owners = find_windows(docs, benchmark, window)
    found = materialize(found, "found")
    span = F.when(F.col("at").isNotNull(), F.struct("at", "size"))
    spans = found.groupBy("doc_id", "key", "n_words").agg(F.count_if(F.col("at").isNull()).alias("copies"), F.sort_array(F.collect_set(span)).alias("spans"))
    hit = found.where("window_id is not null").select("doc_id", "key", "window_id").distinct()
    of = hit.join(owners, "window_id").select("doc_id", "key", "item_id").distinct().groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = spans.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    # spans are in order of their starts: each one adds the words behind the furthest end so far
    merged = "aggregate(spans, struct(0 as hit, 0 as top), (s, v) -> struct(s.hit + greatest(0, v.at + v.size - greatest(v.at, s.top)) as hit, greatest(s.top, v.at + v.size) as top), s -> cast(s.hit as bigint))"
    found = found.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.expr(merged).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "copies")
    found = found.withColumn("contaminated", F.expr(f"n_hit > 0 and {min_share} * n_hit >= n_words"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "_copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """``docs`` without the rows that are contaminated; every row is judged by its own text, and all columns stay."""
    bad = contamination(docs, benchmark, window, min_share).where("contaminated").select(F.col("doc_id").alias("id"), "key").distinct()
    bad = materialize(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    # columns of ``docs`` may have any name, so both sides have one of their own
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.id")) & (_key("d.text") == F.col("b.key")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, text) of the rows of ``docs`` that hold a window: the words that aren't hit, joined by blanks.

    Words are those that windows are made of, A-Z in lower case; rows without any hit aren't returned.
    """
    hits = find_windows(docs, benchmark, window)[0].where("at is not null").select("doc_id", "key", "at", "size").distinct()
    spans = hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("spans"))
    own = docs.select(F.col("doc_id").alias("_id"), _key().alias("_key"), _words("text").alias("w"))
    own = own.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    kept = F.expr("transform(array_except(sequence(1, size(w)), flatten(transform(spans, v -> sequence(v.at, v.at + v.size - 1)))), p -> element_at(w, p))")
    return own.select("doc_id", F.size("w").cast("long").alias("n_words"), (F.size("w") - F.size(kept)).cast("long").alias("n_hit"), F.array_join(kept, " ").alias("text"))
