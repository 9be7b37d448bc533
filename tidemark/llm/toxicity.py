"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of words, their beginnings (which tie the forms of a word together), neighbouring
pairs and pairs with one word between, each counted once a text. Training takes a bounded sample of labelled
rows, dealt to shards of bounded rows and bytes; each shard runs FTRL with per-coordinate rates over its rows,
and the shards' weights are averaged. L1 leaves a few thousand coordinates, which are broadcast and looked up
in one vectorised pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import hash_bound, held, materialize, release, widened
from ._words import ALNUM, mix, run_hashes, text_slices, words

#: Labelled rows to learn from, characters up to which a text is one of them, and weights of the model at most.
MAX_ROWS, MAX_ROW_CHARS, MAX_WEIGHTS = 32_768, 32_768, 262_144
#: Rows and bytes of a shard.
SHARD_ROWS, SHARD_BYTES = 4096, 12 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
MIN_WEIGHT = 1e-3
#: Bytes of a word's beginning that stand for it besides the word, if it is longer.
STEMS = (5, 6, 7, 8)
_NONE = np.zeros(0, np.uint64)

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def features(hashes: np.ndarray, stems: np.ndarray = _NONE) -> np.ndarray:
    """Hashes of the words, their stems, the pairs and the pairs with a gap of one; neither distinct nor in order."""
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1] * _A + hashes[1:] * _B + np.uint64(2))
        skips = mix(hashes[:-2] * _A + hashes[2:] * _B + np.uint64(3))
    return np.concatenate([hashes, stems, pairs, skips])


def _feature_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in text_slices(texts):
        starts, ends, at = words(data, offsets, ALNUM)
        hashes, *stems = run_hashes(data, starts, [ends, *(np.minimum(starts + n, ends) for n in STEMS)], lower=True)
        stems = np.stack([mix(x) for x in stems], axis=1)
        longer = np.stack([ends - starts > n for n in STEMS], axis=1)
        for i in range(hi - lo):
            own = slice(at[i], at[i + 1])
            yield features(hashes[own], stems[own][longer[own]])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, coordinates, weights) after ``epochs`` passes of FTRL-proximal over binary features."""
    coordinates = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    rows = [np.searchsorted(coordinates, np.unique(r)).astype(np.int32) for r in rows]
    z, n = np.zeros(len(coordinates) + 1), np.zeros(len(coordinates) + 1)  # the last one is the bias

    def weights(zi, ni, first):
        return np.where(np.abs(zi) <= first, 0.0, (np.sign(zi) * first - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    bias = len(coordinates)
    for _ in range(epochs):
        for k in range(len(rows)):
            i = rows[k]
            w, wb = weights(z[i], n[i], l1), weights(z[bias], n[bias], 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - labels[k]
            for j, wj in ((i, w), (bias, wb)):
                root = np.sqrt(n[j])
                n[j] += g * g
                z[j] += g - (np.sqrt(n[j]) - root) / alpha * wj
    w = weights(z[:bias], n[:bias], l1)
    kept = np.abs(w) >= MIN_WEIGHT
    return float(weights(z[bias], n[bias], 0.0)), coordinates[kept], w[kept]


def _frequent_rows(texts: pa.Array) -> list[np.ndarray]:
    """Distinct features of every text, without those that can't get a weight.

    A feature that isn't in more than L1 / EPOCHS texts gathers gradients of L1 at most, so that its weight is
    zero throughout. Counts are kept by 22 bits of the hash, which never makes them smaller.
    """
    counts = np.zeros(1 << 22, np.uint16)
    for row in _feature_rows(texts):
        np.add.at(counts, np.unique(row) >> np.uint64(42), 1)
    kept = counts > L1 / EPOCHS
    return [u[kept[u >> np.uint64(42)]] for u in map(np.unique, _feature_rows(texts))]


def _train(rows: pa.Table) -> pa.Table:
    held("toxicity")
    rows = rows.sort_by([("at", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    bias, coordinates, w = ftrl(_frequent_rows(rows["text"]), rows["toxic"].to_numpy())
    release()
    return pa.table({"coordinate": pa.array([None, *coordinates.view(np.int64).tolist()], pa.int64()), "w": pa.array([bias, *w.tolist()], pa.float64())})


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(at, toxic, text) of the first ``max_rows`` rows of ``labels`` in the order of a hash.

    Null labels and ids are left out, and so are ids without a text of MAX_ROW_CHARS at most; a doc_id with
    several labels is several examples. Of rows of ``docs`` that repeat a doc_id, the least text is taken, so
    that the sample keeps its bound.
    """
    spark = docs.sparkSession
    picked = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).dropna().withColumn("at", F.xxhash64("doc_id", "toxic"))
    different = picked.agg(F.approx_count_distinct("at", 0.02)).first()[0]
    picked = picked.where(F.col("at") <= hash_bound(max_rows + max_rows // 8, different)).distinct().orderBy("at", "doc_id").limit(max_rows)
    picked = spark.createDataFrame(picked.toArrow())  # max_rows rows of 24 bytes
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= MAX_ROW_CHARS)
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "at", "toxic").agg(F.min("text").alias("text")).select("at", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, coordinates, weights), fitted on the ``sample`` of ``labels``.

    The MAX_WEIGHTS weights of the greatest size make the model, which bounds the broadcast to 4 MB; L1 leaves
    far fewer on ordinary texts. Without rows the model is empty and the bias is -35, which scores all texts 0.
    """
    rows = materialize(sample(docs, labels, max_rows), "sample")
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size["rows"] // SHARD_ROWS), -(-(size["bytes"] or 0) // SHARD_BYTES))
    trained = rows.withColumn("shard", F.pmod("at", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_train, "coordinate long, w double")
    mean = trained.groupBy("coordinate").agg((F.sum("w") / shards).alias("w"))
    found = mean.where(f"coordinate is null or abs(w) >= {MIN_WEIGHT}").orderBy(F.col("coordinate").isNotNull(), F.abs("w").desc(), "coordinate").limit(MAX_WEIGHTS).toArrow()
    bias = found.filter(found["coordinate"].is_null())["w"].to_pylist()
    found = found.filter(found["coordinate"].is_valid())  # in Arrow: 64 bits don't fit a nullable pandas column
    coordinates, w = found["coordinate"].to_numpy().view(np.uint64), found["w"].to_numpy()
    order = np.argsort(coordinates)
    return bias[0] if bias else -35.0, coordinates[order], w[order]


def _scores(model, texts: pa.Array) -> np.ndarray:
    bias, coordinates, w = model
    sums = []
    for row in _feature_rows(texts):
        found = 0.0
        if len(row) and len(coordinates):
            at = np.minimum(np.searchsorted(coordinates, row), len(coordinates) - 1)
            found = w[np.unique(at[coordinates[at] == row])].sum()
        sums.append(found + bias)
    return 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))


def _score(model, at: int, kept: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        for batch in batches:
            scores = pa.array(_scores(model.value, batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), scores], [*(batch.schema.names[k] for k in kept), "score"])
            release()

    return run


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``score`` in 0..1 from the whole text alone.

    Null and empty texts get the bias's score. A column ``score`` of ``docs`` is replaced.
    """
    docs = docs.drop("score")
    columns = [c for c in columns or docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared, docs.columns.index("text"), [docs.columns.index(c) for c in columns]), widened(docs.select(columns), score="double"))


def _passing(model, at: int, below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(at)) < below))
            release()

    return run


def remove_toxic(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``; every row is judged on its own text and all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_passing(shared, docs.columns.index("text"), threshold), docs.schema)


def held_out() -> Column:
    """Whether crc32 of a row's doc_id as text is divisible by 5; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, fitted on the labels of rows that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    found = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
