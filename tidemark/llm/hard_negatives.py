"""Hard negatives: every anchor's full list of integer scores, sorted, with limits set by its positives.

Anchors and rows are packed into blocks, and every block of anchors meets every block of rows in one cell of a grid:
the key of the join is (part of the anchors, slice of the rows), so that no cell holds more than some anchors and some
rows, whatever the table's size, and neither side passes through the driver. A cell computes its scores as one matrix
product, sorts each anchor's by score and id and hands on what can still be in the result: the first rows of the same
label in a first pass, and, once the positives are known, the first of other labels below each positive's upper limit in
a second one. Sorted lists of slices merge into the sorted list of the table, so the first of all are among the first of each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, release

#: Components become floor(SCALE * x).
SCALE = 256.0
ANCHOR_BLOCK, ROW_BLOCK, SLICE_ROWS = 1024, 4096, 32768
LONG = 2**63 - 1
#: Below this, sums of products of two components each are computed as they are; other rows are computed one by one in whole numbers.
PLAIN = 2.0**24
_PACKED = "part int, no binary, ids binary, labels binary, width int, dims int, v binary, limits binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of lists of doubles; shorter lists are filled up with zeros."""
    offsets = np.asarray(column.offsets)
    values = np.floor(SCALE * np.asarray(column.values, dtype=float)[offsets[0] : offsets[-1]])
    lengths = np.diff(offsets)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def _fitted(x: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds every value."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def _pack(size: int):
    """Rows (no, vec_id, label, v, limits) as blocks of ``size`` rows; ``part`` is the task's number."""

    def row(no, ids, labels, vectors, limits):
        v = _fitted(_joined(vectors))
        flat = [np.concatenate(x).astype(np.int64).tobytes() for x in (no, ids, labels)]
        own = TaskContext.get().partitionId()
        values = [own, *flat, v.itemsize, v.shape[1], v.tobytes(), np.concatenate(limits).tobytes()]
        kinds = [pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["part", "no", "ids", "labels", "width", "dims", "v", "limits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for k in range(0, len(batch), size):
                b = batch.slice(k, size)
                lists = b.column(4)
                limits = np.full((len(b), 1), -LONG, np.int64)
                if lists.null_count == 0 and len(b):
                    offsets = np.asarray(lists.offsets)
                    own = np.diff(offsets)
                    limits = np.full((len(b), 1 + int(own.max(initial=0))), -LONG, np.int64)
                    limits[np.repeat(np.arange(len(b)), own), np.arange(own.sum()) - np.repeat(offsets[:-1] - offsets[0], own)] = np.asarray(lists.values)[offsets[0] : offsets[-1]]
                    limits = np.concatenate([own[:, None], limits[:, :-1]], axis=1)
                for at, x in zip(held, [*(np.asarray(b.column(j)) for j in range(3)), _matrix(b.column(3)), limits]):
                    at.append(x)
                if sum(map(len, held[0])) >= size:
                    yield row(*held[:4], [_joined(held[4])])
                    held = [[], [], [], [], []]
        if held[0]:
            yield row(*held[:4], [_joined(held[4])])
        release()

    return run


def _unpacked(row: dict, n: int) -> np.ndarray:
    return np.frombuffer(row["v"], {2: np.int16, 4: np.int32, 8: np.float64}[row["width"]]).reshape(n, row["dims"]).astype(np.float64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of the rows of ``a`` and ``b`` (whole numbers as doubles), exact; those beyond a long are the nearest long."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    large_a, large_b = (np.abs(x).max(axis=1, initial=0) >= PLAIN for x in (a, b))
    plain_a, plain_b = np.where(large_a[:, None], 0, a), np.where(large_b[:, None], 0, b)
    if np.abs(plain_a).max(initial=0) * np.abs(plain_b).max(initial=0) * wide < 2.0**53:
        out = (plain_a @ plain_b.T).astype(np.int64)
    else:
        out = plain_a.astype(np.int64) @ plain_b.astype(np.int64).T
    exact = lambda x, y: max(-LONG, min(LONG, sum(int(p) * int(q) for p, q in zip(x, y))))
    for i in np.flatnonzero(large_a):
        out[i] = [exact(a[i], y) for y in b]
    for j in np.flatnonzero(large_b):
        out[:, j] = [exact(x, b[j]) for x in a]
    return out


def _ranked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of every anchor of each row of the join: (no, id, label, limits, ids, labels, scores) with the rows by score, descending, and id."""
    for row in batch.to_pylist():
        no, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("a_no", "a_ids", "a_labels"))
        of, kinds = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        limits = np.frombuffer(row["a_limits"], np.int64).reshape(len(no), -1)
        a, b = _unpacked({k[2:]: x for k, x in row.items() if k.startswith("a_")}, len(no)), _unpacked(row, len(of))
        for k in range(0, len(no), 64):
            scores = inner_products(a[k : k + 64], b)
            order = np.lexsort((np.broadcast_to(of, scores.shape), -scores))
            for i, (s, o) in enumerate(zip(scores, order), k):
                o = o[of[o] != ids[i]]
                yield no[i], ids[i], labels[i], limits[i], of[o], kinds[o], s[o]


def _table(rows: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    found = np.concatenate(rows) if rows else np.zeros((0, len(names)), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names)


def _same_label(positives: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for no, own, label, _, ids, kinds, scores in _ranked(batch):
            at = np.flatnonzero(kinds == label)[:positives]
            rows.append(np.stack([np.full(len(at), no), np.full(len(at), own), ids[at], scores[at]], axis=1))
        yield _table(rows, ["no", "anchor_id", "positive_id", "score"])
    release()


def _below(k: int, low: int, high: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for no, own, label, limits, ids, kinds, scores in _ranked(batch):
            other = np.flatnonzero(kinds != label)
            of_other = scores[other]
            for place, positive in enumerate(limits[1 : 1 + limits[0]].tolist()):
                most, least = high * positive // 100, -(-low * positive // 100)
                first = int(np.searchsorted(-of_other, -most))
                at = other[first : first + k]
                at = at[scores[at] >= least]
                if len(at):
                    rows.append(np.stack([np.full(len(at), no), np.full(len(at), place), np.full(len(at), positive), ids[at], scores[at]], axis=1))
        yield _table(rows, ["no", "place", "positive_score", "negative_id", "negative_score"])
    release()


def _met(anchors: DataFrame, blocks: DataFrame, parts: int, slices: int) -> DataFrame:
    """Every part of the anchors with every block of rows, dealt out by part and slice."""
    cells = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts * slices, "part", "slice")
    asked = anchors.select("part", *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "part"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return cells.join(asked, ["part", "slice"]).drop("part", "slice", "no", "limits")


def mine(vectors: DataFrame, anchors: str | Column, k: int = 3, positives: int = 5, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label) that ``anchors`` names.

    Scores are inner products of floor(256 * x). An anchor's positives are its first ``positives`` rows of the same
    label; each gets the first ``k`` rows of other labels whose score is from ``low`` to ``high`` percent of its own.
    Higher scores come first, ties by the smaller vec_id. ``label`` is a whole number. Rows with a null vec_id, label or
    vector or with a null or non-finite component take no part. A vector that is shorter than another has zeros after
    its end. Rows that repeat a vec_id are rows of their own, but none is a partner of an anchor with its id. Scores
    beyond a long count as the nearest long. Anchors without positives, positives without such negatives and an empty
    table give no rows. Other columns are ignored.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    chosen = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~odd).withColumn("_anchor", F.expr(anchors) if isinstance(anchors, str) else anchors)
    rows = chosen.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), "_anchor")
    own = materialize(rows.where("_anchor").drop("_anchor").withColumn("no", F.monotonically_increasing_id()), "anchors")
    n, total, cores = own.count(), rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // ANCHOR_BLOCK), min(cores, n // 64))
    slices = max(1, -(-total // SLICE_ROWS))
    fields = lambda df, limits: df.select("no", "vec_id", "label", "v", limits)
    none = F.lit(None).cast("array<long>").alias("limits")
    blocks = fields(rows.withColumn("no", F.lit(0).cast("long")), none).mapInArrow(_pack(ROW_BLOCK), _PACKED)
    blocks = materialize(blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")).drop("part"), "blocks")
    packed = materialize(fields(own, none).repartition(parts).mapInArrow(_pack(ANCHOR_BLOCK), _PACKED), "anchors")
    found = materialize(_met(packed, blocks, parts, slices).mapInArrow(functools.partial(_same_label, positives), "no long, anchor_id long, positive_id long, score long"), "same")
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "positive_id"))
    kept = materialize(found.withColumn("place", place - 1).where(F.col("place") < positives), "positives")
    limits = kept.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s")).select("no", F.col("s.score").alias("limits"))
    asked = materialize(fields(own.join(limits, "no"), F.col("limits")).repartition(parts).mapInArrow(_pack(ANCHOR_BLOCK), _PACKED), "anchors")
    below = functools.partial(_below, k, low, high)
    found = materialize(_met(asked, blocks, parts, slices).mapInArrow(below, "no long, place long, positive_score long, negative_id long, negative_score long"), "negatives")
    rank = F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = kept.select("no", F.col("place").cast("long").alias("place"), "anchor_id", "positive_id")
    return first.join(named, ["no", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
