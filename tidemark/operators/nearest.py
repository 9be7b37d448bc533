"""Nearest vectors by cosine: exactly, block by block, or through an index of inverted lists.

Vectors are packed into blocks, so that a query set meets all rows as products of small matrices and the join has a row
for a pair of blocks, not for a pair of vectors; each block hands on its best ``k`` of every query and no more.

The index has the lists of a coarse quantiser: spherical k-means on a bounded sample, every vector in the list of its
nearest centroid. A search probes the lists nearest to its query and scores their vectors exactly. With ``exact`` it then
also takes each list that could still hold a better one: a list's vectors lie within an angle of its centroid, which
bounds their similarity to any query. Lists are partitions of a Parquet table; long ones are dealt out over many files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIGITS = 6
QUERY_ROWS, BLOCK_ROWS = 256, 1024
#: Vectors that k-means learns from at most, lists of an index at most, and rounds of k-means.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 16_384, 4096, 8
#: Vectors of a list up to which they are one file.
LIST_FILE = 500_000
#: Lists that a search probes, as a share of all: so many find nine in ten of the nearest even among vectors without any structure.
PROBED = 0.65
NONE_YET = -2.0


def _units(column: pa.Array) -> np.ndarray:
    """Lists of doubles as rows of length one; shorter lists are filled up with zeros, zero vectors stay."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values, dtype=float)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def _as_wide(parts: list[np.ndarray]) -> list[np.ndarray]:
    wide = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts]


def _pack(rows: int):
    def block(cell, ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        ids, v = pa.concat_arrays(ids), np.concatenate(_as_wide(vectors))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.string()), listed, pa.array([v.tobytes()], pa.binary()), pa.array([v.shape[1]], pa.int32())], ["cell", "ids", "v", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, n = None, [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            cells, v = batch.column(0), _units(batch.column(2))
            codes = np.asarray(cells.dictionary_encode().indices)
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, end in zip(starts, starts[1:]):
                cell = cells[lo].as_py()
                while lo < end:
                    if n and (cell != now or n == rows):
                        yield block(now, ids, vectors)
                        ids, vectors, n = [], [], 0
                    now, hi = cell, min(end, lo + rows - n)
                    ids.append(batch.column(1).slice(lo, hi - lo))
                    vectors.append(v[lo:hi])
                    n, lo = n + hi - lo, hi
        if n:
            yield block(now, ids, vectors)

    return run


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(cell, ids, v, dims): rows (cell string, id, v array<double>) as blocks of ``size`` rows of one cell at most."""
    return rows.select("cell", "id", "v").mapInArrow(_pack(size), f"cell string, ids array<{rows.schema['id'].dataType.simpleString()}>, v binary, dims int")


def _matrix(row: dict, side: str, n: int) -> np.ndarray:
    return np.frombuffer(row[f"{side}v"]).reshape(n, row[f"{side}dims"])


def _best(k: int, threshold: float | None, itself: bool):
    """The first ``k`` of a block for each query of another block, by rounded score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(batch.schema.names.index(c))[at] for c in batch.schema.names}
                asked, ids = row["q_ids"].values, row["ids"].values
                row = {c: x.as_py() for c, x in row.items() if c in ("cell", "q_v", "q_dims", "v", "dims")}
                q, v = _as_wide([_matrix(row, "q_", len(asked)), _matrix(row, "", len(ids))])
                scores = np.round(q @ v.T, DIGITS) + 0.0
                order = np.empty(len(ids), np.int64)
                order[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
                if not itself:
                    place: dict = {}
                    for j, x in enumerate(ids.to_pylist()):
                        place.setdefault(x, []).append(j)
                    for i, x in enumerate(asked.to_pylist()):
                        scores[i, place.get(x, [])] = NONE_YET
                of, who, score = [], [], []
                for i, s in enumerate(scores):
                    least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else NONE_YET
                    own = np.flatnonzero((s >= least) & (s > NONE_YET))
                    own = own[np.lexsort((order[own], -s[own]))[:k]]
                    own = own if threshold is None else own[s[own] >= threshold]
                    of.append(np.full(len(own), i)), who.append(own), score.append(s[own])
                of, who = pa.array(np.concatenate(of)), pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([pa.array([row["cell"]] * len(of), pa.string()), asked.take(of), ids.take(who), pa.array(np.concatenate(score), pa.float64())], ["cell", "query_id", "vec_id", "score"])

    return run


def _scored(met: DataFrame, k: int, threshold: float | None, itself: bool) -> DataFrame:
    """(cell, query_id, vec_id, score) of joined blocks (cell, q_ids, q_v, q_dims, ids, v, dims)."""
    kinds = tuple(met.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids"))
    rows = met.select("cell", "q_ids", "q_v", "q_dims", "ids", "v", "dims")
    return rows.mapInArrow(_best(k, threshold, itself), f"cell string, query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def _ranked(scored: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _usable(df: DataFrame, key: str, cell) -> DataFrame:
    """(cell, id, v): rows with an id and a vector without null or non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).where(~odd).select(cell.alias("cell"), F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, threshold: float | None = None, scope: str | None = None, itself: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank) and ``scope``: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each of ``queries`` (query_id, embedding).

    Exact: every query meets all rows, or those of its ``scope`` (a column of both; null is no scope). Scores are cosines,
    rounded; ties go to the smaller id. Scores under ``threshold`` don't count. Without ``itself`` a row isn't found by
    a query of its own id. Rows with a null id, a null vector, or a null or non-finite component take no part; a
    zero vector has similarity 0 to all. Neither side is counted or kept: each is read once.

    The blocks of ``vectors`` are dealt out over as many slices as there are shuffle partitions, those of queries are
    sent to each slice; a query's best of each slice come together at the end.
    """
    spark = vectors.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.col(scope).cast("string") if scope else F.lit("")
    side = lambda df, key, rows: packed(_usable(df, key, cell).where("cell is not null").sortWithinPartitions("cell") if scope else _usable(df, key, cell), rows)
    blocks = side(vectors, "vec_id", BLOCK_ROWS).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    asked = side(queries, "query_id", QUERY_ROWS).select("cell", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.col("dims").alias("q_dims"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    found = _ranked(_scored(blocks.join(asked, ["cell", "slice"]), k, threshold, itself), k, "cell")
    own = [F.col("cell").cast(vectors.schema[scope].dataType).alias(scope)] if scope else []
    return found.select("query_id", "vec_id", "score", *own, "rank")


def _kmeans(lists: int):
    def run(pdf):
        import pandas as pd

        x = _units(pa.array(pdf.sort_values("at")["v"].tolist(), pa.list_(pa.float64())))
        rng = np.random.default_rng(13)
        centres = x[rng.permutation(len(x))[:lists]]
        for _ in range(ROUNDS):
            of = np.concatenate([(x[k : k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(x), 4096)])
            sums = np.zeros_like(centres)
            np.add.at(sums, of, x)
            size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        return pd.DataFrame({"list": np.arange(len(centres), dtype=np.int32), "centre": list(centres)})

    return run


def _assign(shared):
    """Rows (id, v) with the number of the nearest centroid and the cosine to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, centres = _as_wide([_units(batch.column(1)), shared.value])
            near = v @ centres.T
            own = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(own)), own])], ["id", "v", "list", "cosine"])

    return run


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Write an index of all of ``vectors`` (vec_id, embedding) to ``path``; it counts once its manifest is there.

    The quantiser learns from SAMPLE_ROWS rows at most, the first by a hash of their ids, in one task. There are
    ``lists`` lists, by default the root of the number of rows, MAX_LISTS at most. Rows that can't be searched for (as
    in ``nearest``) are left out; an empty table gives an index without lists.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, "vec_id", F.lit("")).drop("cell")
    n = rows.count()
    lists = max(1, min(MAX_LISTS, lists or round(n**0.5)))
    at = F.xxhash64("id", F.lit(17))
    bound = 2**63 - 1 if n <= SAMPLE_ROWS else int(-(2**63) + 2**64 * min(1.0, 1.2 * SAMPLE_ROWS / n))
    sample = rows.select(at.alias("at"), "v").where(F.col("at") <= bound).orderBy("at").limit(SAMPLE_ROWS)
    sample.groupBy(F.lit(1).alias("one")).applyInPandas(_kmeans(lists), "list int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    shared = spark.sparkContext.broadcast(_centres(spark, path))  # MAX_LISTS vectors at most
    if not len(shared.value):
        spark.createDataFrame([], f"list int, size long, least double, cell string, ids array<{rows.schema['id'].dataType.simpleString()}>, v binary, dims int").write.mode("overwrite").parquet(f"{path}/empty")
    else:
        assigned = rows.mapInArrow(_assign(shared), f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, list int, cosine double")
        assigned.write.mode("overwrite").parquet(f"{path}/assigned")
        assigned = spark.read.parquet(f"{path}/assigned")
        sizes = assigned.groupBy("list").agg(F.count("*").alias("size"), F.min("cosine").alias("least"))
        sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        files = F.ceil(F.col("size") / F.lit(LIST_FILE)).cast("int")
        dealt = assigned.join(F.broadcast(spark.read.parquet(f"{path}/sizes")), "list")  # a row a list
        dealt = dealt.withColumn("file", F.pmod(F.xxhash64("id"), files)).repartition("list", "file").sortWithinPartitions("list")
        blocks = packed(dealt.select(F.col("list").cast("string").alias("cell"), "id", "v"), BLOCK_ROWS)
        blocks.withColumn("list", F.col("cell").cast("int")).drop("cell").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(n,)], "n_vectors long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MAX_LISTS at most
    return np.array([r["centre"] for r in found]) if found else np.zeros((0, 0))


def _probes(shared, first: int, last: int | None, exact: bool):
    """Of each query (cell, id, v, least): the lists from place ``first`` to ``last`` by nearness; with ``exact``, of them those that may hold a score of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, widest = shared.value
        for batch in batches:
            if not len(batch):
                continue
            q, c = _as_wide([_units(batch.column(2)), centres])
            near = q @ c.T
            order = np.argsort(-near, axis=1, kind="stable")[:, first:last]
            rows = np.repeat(np.arange(len(q)), order.shape[1])
            cols = order.ravel()
            if exact:
                # of a list whose vectors lie within an angle of the centroid, the nearest a query can be
                angle = np.arccos(np.clip(near[rows, cols], -1, 1)) - widest[cols]
                most = np.where(angle <= 0, 1.0, np.cos(np.maximum(angle, 0)))
                zero = ~np.any(q, axis=1)[rows]
                may = (most + 2 * 10.0**-DIGITS >= np.asarray(batch.column(3))[rows]) | zero
                rows, cols = rows[may], cols[may]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cols.astype(str), pa.string()), batch.column(1).take(at), batch.column(2).take(at)], ["cell", "id", "v"])

    return run


def search(path: str, queries: DataFrame, k: int = 3, probes: int | None = None, exact: bool = False, threshold: float | None = None, itself: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank) of ``queries`` (query_id, embedding) in the index at ``path``.

    ``probes`` lists are searched for each query, by default the share PROBED of them. Scores are those of
    ``nearest``. With ``exact`` the rows are those of ``nearest`` too: the lists that the bounds can't rule out are
    searched in a second step.
    """
    spark = queries.sparkSession
    centres = _centres(spark, path)
    asked = _usable(queries, "query_id", F.lit(""))
    kind = asked.schema["id"].dataType.simpleString()
    if not len(centres):
        ids = spark.read.parquet(f"{path}/empty").schema["ids"].dataType.elementType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, vec_id {ids}, score double, rank int")
    widest = np.full(len(centres), 0.0)
    for r in spark.read.parquet(f"{path}/sizes").collect():  # a row a list
        widest[r["list"]] = np.arccos(np.clip(r["least"], -1, 1)) + 1e-6
    shared = spark.sparkContext.broadcast((centres, widest))
    probes = max(1, min(len(centres), probes or round(PROBED * len(centres))))

    def step(rows: DataFrame, first: int, last: int | None, bounded: bool) -> DataFrame:
        met = rows.mapInArrow(_probes(shared, first, last, bounded), f"cell string, id {kind}, v array<double>").repartition("cell").sortWithinPartitions("cell")
        met = packed(met, QUERY_ROWS).select("cell", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.col("dims").alias("q_dims"))
        lists = spark.read.parquet(f"{path}/lists").withColumn("cell", F.col("list").cast("string"))
        # Queries repeat once a list and pack well, so that their files look small enough to broadcast: that would take all of them through the driver.
        return _ranked(_scored(lists.join(met.hint("merge"), "cell"), k, threshold, itself).drop("cell"), k).drop("rank")

    found = step(asked, 0, probes, False)
    if exact and probes < len(centres):
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        low = F.lit(NONE_YET if threshold is None else float(threshold))
        more = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").select("cell", "id", "v", F.when(F.col("n") >= k, F.greatest("least", low)).otherwise(low).alias("least"))
        found = found.unionByName(step(more, probes, None, True))
    return _ranked(found, k)
