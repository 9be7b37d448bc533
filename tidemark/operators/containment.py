"""Which texts contain which items, letter by letter, without a pair being looked at that can't be one.

Each item is looked for by one gram of its own: the one that the fewest texts have, of all its runs of 16 characters (8, 4,
2 or 1, if it is shorter). A text hands on the hashes of the grams that some item has chosen, never itself; only
texts that meet an item are read again and searched for it. Nothing is bounded but what tasks hold: more grams than
MAX_GRAMS are met in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.segment import _codes, _hashes
from tidemark.sources.scratch import kept

SIZES = (16, 8, 4, 2, 1)
#: Grams up to which tasks get them as a sorted list (8 bytes each).
MAX_GRAMS = 2_000_000
#: Texts with a likely item up to which their ids are broadcast.
BROADCAST_IDS = 500_000
#: Characters that are hashed together.
_TOGETHER = 1 << 18


def _grams(texts: list[str], sizes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, text's number, hash) of all runs of each size."""
    lengths = np.array([len(t) for t in texts])
    codes, of = _codes("".join(texts)), np.repeat(np.arange(len(texts)), lengths)
    for size in sizes:
        if len(codes) >= size:
            found = _hashes(codes, size)
            within = of[: len(found)] == of[size - 1 :]
            yield size, of[: len(found)][within], found[within]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    texts, lo, n = [], 0, 0
    for k, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n >= _TOGETHER:
            yield lo, texts
            texts, lo, n = [], k + 1, 0
    if texts:
        yield lo, texts


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size in SIZES:
            own = [t for t in batch.column(0).to_pylist() if len(t) >= size and (size == SIZES[0] or len(t) < SIZES[SIZES.index(size) - 1])]
            for _, of, found in _grams(own, (size,)) if own else ():
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(of)), pa.array(np.full(len(of), size, np.int32)), pa.array(found.view(np.int64))], ["item", "size", "gram"])


def _known(wanted: DataFrame):
    """The grams (size, gram) as sorted lists by size, if they are few enough, and the sizes."""
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]  # five at most
    if wanted.limit(MAX_GRAMS + 1).count() > MAX_GRAMS:
        return None, sizes
    rows = wanted.toPandas()
    return {s: np.sort(rows["gram"][rows["size"] == s].to_numpy(np.int64).view(np.uint64)) for s in sizes}, sizes


def _met(texts: list[str], known, sizes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, text's number, gram) of the wanted grams of each text, each once."""
    for size, of, found in _grams(texts, sizes):
        if known is not None:
            own = known[size]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            there = own[at] == found
            of, found = of[there], found[there]
        both = np.unique(np.stack([of.astype(np.uint64), found], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.uint64)
        yield size, both[:, 0].astype(np.int64), both[:, 1]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        for batch in batches:
            for _, texts in _slices(batch, 0):
                for size, _, found in _met(texts, known, sizes):
                    gram, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["size", "gram", "n"])

    return run


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        for batch in batches:
            for lo, texts in _slices(batch, 2):
                for size, of, found in _met(texts, known, sizes):
                    at = pa.array(of + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(of), size, np.int32)), pa.array(found.view(np.int64))], ["id", "mark", "size", "gram"])

    return run


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, mark, item): the different ``items`` (item) that each of ``texts`` (id, text) contains as they are written.

    ``mark`` is xxhash64 of the text: rows that repeat an id are told apart by it. Null texts, null items and empty items
    are in no pair; equal rows give one.
    """
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.where("text is not null").select("id", F.xxhash64("text").alias("mark"), "text")
    grams = kept(items.select("item").where("item <> ''").distinct().mapInArrow(_of_items, "item string, size int, gram long").distinct(), "grams")
    known = share(_known(grams.select("size", "gram").distinct()))
    counts = rows.select("text").mapInArrow(_count(known), "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    # an item with a gram that no text has is in none
    chosen = grams.join(counts, ["size", "gram"], "left").groupBy("item").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram")).alias("g")).where("g.n > 0")
    chosen = kept(chosen.select("item", "g.size", "g.gram"), "chosen")
    known = share(_known(chosen.select("size", "gram").distinct()))
    likely = rows.mapInArrow(_keys(known), f"id {kind}, mark long, size int, gram long").join(chosen, ["size", "gram"])
    likely = kept(likely.select("id", "mark", "item").distinct(), "likely")
    ids = likely.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    own = rows.join(ids, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")
    pairs = likely.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "item")
    met = own.join(pairs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return met.where(F.col("text").contains(F.col("item"))).select("id", "mark", "item").distinct()
