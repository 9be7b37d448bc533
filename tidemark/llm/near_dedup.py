"""MinHash near-duplicate components with circulant signatures and exact verification.

One pass over the texts gives each row its shingle count, a digest of its word sequence and its band keys.
Two permutations of a fixed universe make the whole signature: a shingle is sent through the first, and the
second, shifted circularly by k, gives its k-th value. The K values of one shingle therefore lie side by side
in the second permutation, so a signature is a columnwise minimum of K-wide slices.

Rows of one word sequence are one class, stood for by its least doc_id; copies never meet in pairs. In every
band bucket the representatives are compared with one hub, not with each other, and every comparison is
verified on the full sets of two-word shingles. Rounds of other hubs follow as long as many members are still in
other components, then the pairs of members in different components of a bucket, so no candidate is left out.
Those meet by classes of size, under bounds on their sizes and on the bits in which bitmaps of their sets differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, merged
from ._store import discard, held, materialize, release
from ._words import mix, text_slices, word_hashes, words

UNIVERSE_BITS = 20
BANDS, ROWS = 45, 6
#: Rounds of other hubs, as long as they find links, before the members of different components are compared with each other.
HUB_ROUNDS = 4
#: Longs of the bitmap that each shingle sets one bit of. Two bitmaps differ in at most as many bits as the sets
#: have elements that aren't common, which bounds the similarity from above without any error.
BITMAP = 32
_BITS = [f"s{k}" for k in range(BITMAP)]
BROADCAST_IDS = 500_000


def _permutations(width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and K-wide slices of the second one, wrapped around."""

    def make():
        rng = np.random.default_rng(seed)
        n = 1 << UNIVERSE_BITS
        first, second = rng.permutation(n).astype(np.int32), rng.permutation(n).astype(np.int32)
        return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)

    return held(("near_dedup", width, seed), make)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` circulant MinHash values of a set of 64-bit shingles."""
    first, slices = _permutations(width)
    at = first[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full(width, 1 << UNIVERSE_BITS, np.int32)
    for k in range(0, len(at), 4096):
        np.minimum(out, slices[at[k : k + 4096]].min(axis=0), out=out)
    return out


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct two-word shingles of a sequence of word hashes; a single word is its own shingle."""
    if len(hashes) < 2:
        return mix(hashes + np.uint64(1))
    with np.errstate(over="ignore"):
        return np.unique(mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]))


def _sign(bands: int, rows: int):
    weights = np.random.default_rng(11).integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    band_salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1), len(batch)
            counts, digests = np.zeros(n, np.int64), [None] * n
            keys, bitmaps = np.zeros((n, bands), np.uint64), np.zeros((n, 64 * BITMAP), np.uint8)
            for lo, hi, data, offsets in text_slices(texts):
                starts, ends, at = words(data, offsets)
                hashes = word_hashes(data, starts, ends, lower=True)
                signs = np.zeros((hi - lo, bands * rows), np.uint64)
                raw = data.tobytes()
                for i in range(hi - lo):
                    if at[i] == at[i + 1]:
                        continue
                    found = shingle_set(hashes[at[i] : at[i + 1]])
                    counts[lo + i] = len(found)
                    bitmaps[lo + i, (found % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
                    signs[i] = signature(found, bands * rows)
                    digests[lo + i] = hashlib.md5(b" ".join(raw[offsets[i] : offsets[i + 1]].lower().split())).digest()
                with np.errstate(over="ignore"):
                    keys[lo:hi] = mix((signs.reshape(-1, bands, rows) * weights).sum(axis=2, dtype=np.uint64) + band_salt)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            longs = np.packbits(bitmaps, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(digests, pa.binary()), lists, *(pa.array(longs[:, k]) for k in range(BITMAP))], ["doc_id", "n_shingles", "digest", "bands", *_BITS])
            release()

    return run


def _similar(numerator: int, denominator: int):
    def shingles(text: str) -> set:
        w = text.encode().lower().split()
        return set(zip(w, w[1:])) if len(w) > 1 else set(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, set()
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.as_py(), y.as_py()
                if x != hub:
                    hub, own = x, shingles(x)
                other = shingles(y)
                both = len(own & other)
                keep.append(denominator * both >= numerator * (len(own) + len(other) - both) and both > 0)
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield out

    return run


def _verified(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    few = 2 * pairs.count() <= BROADCAST_IDS
    ids = ids if few else materialize(ids.distinct(), "ids")
    ids = F.broadcast(ids) if few or ids.count() <= BROADCAST_IDS else ids
    texts = texts.join(ids, "doc_id", "left_semi")
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_similar(numerator, denominator), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are linked when ``denominator * |A & B| >= numerator * |A | B|`` over lower-cased (A-Z) two-word
    shingles. Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id are returned each, with the component of its own text. Rows with a null doc_id are returned with a
    null component and kept. An empty table gives an empty result. A pair at the threshold is missed by all
    bands with a probability of (1 - 0.8 ** rows) ** bands, 1e-6 by default.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{b} long" for b in _BITS)), "signed")
    classes = materialize(signed.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(b).alias(b) for b in _BITS)), "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "n")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("size")).where("least < most").select("key", "size")
    # buckets of two or more representatives, with the sizes that a similar pair must have; the hub of a bucket
    # is the member that meets the most others in all of its buckets, which edited copies have in their source
    met_members = members = materialize(buckets.join(shared, "key"), "met")
    met = members.groupBy("rep").agg(F.sum("size").alias("met"))
    members = members.join(met, "rep").select("key", "rep", "n", "met")
    hubs = members.groupBy("key").agg(F.min(F.struct(-F.col("met"), "rep")).alias("h")).select("key", F.col("h.rep").alias("hub"))
    members = materialize(members.drop("met").join(hubs, "key"), "members")
    pairs = members.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    links = materialize(_verified(pairs, docs, numerator, denominator), "links")
    discard(pairs, met_members)
    found = materialize(components(links, by_stars=True), "components")
    gained = True
    for turn in range(HUB_ROUNDS + 1):
        mixed = _mixed(members, found) if gained else mixed
        if mixed is None:
            break
        all_pairs = turn == HUB_ROUNDS or not gained or _few(mixed)
        pairs = _by_pair(mixed, classes, numerator, denominator) if all_pairs else _by_hub(mixed, turn)
        sized = f"{denominator} * least(na, nb) >= {numerator} * greatest(na, nb)"
        pairs = materialize(pairs.where("a <> b").where(sized).select("a", "b").distinct(), "pairs")
        links = materialize(_verified(pairs, docs, numerator, denominator), "links")
        discard(pairs)
        gained = not links.isEmpty()
        if gained:
            before, found = found, materialize(merged(found, links), "components")
            discard(before)
        if all_pairs:
            break
    of_class = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id stands for its component; all columns stay.

    Only the ids to drop are joined back, so that the texts aren't shuffled where these are few. A doc_id
    goes with all of its rows if any of them isn't kept; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    gone = materialize(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """Members (key, rep, n, comp) of the buckets that hold more than one component; None if there are none."""
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    now = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    several = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    mixed = materialize(now.join(several, "key"), "mixed")
    return None if mixed.isEmpty() else mixed


def _few(mixed: DataFrame) -> bool:
    """Whether the pairs of members in different components are not many more than the members."""
    own = mixed.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
    row = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
    return row["pairs"] <= max(100_000, 4 * row["n"])


def _by_hub(mixed: DataFrame, turn: int) -> DataFrame:
    """Every member against one other hub of its bucket, where the components differ."""
    hub = mixed.groupBy("key").agg(F.min_by(F.struct("rep", "n", "comp"), F.xxhash64("rep", "key", F.lit(turn))).alias("h"))
    return mixed.join(hub, "key").where("comp <> h.comp").select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb"))


def _by_pair(mixed: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs of a bucket's members in different components whose sizes and bitmaps allow a link.

    Members meet by bucket and class of size, a class being as wide as the sizes of a link may differ, so that
    one side stands in its own class and the other in three. Sizes and bitmaps are conditions of the join:
    pairs below the threshold are hardly ever rows.
    """
    mixed = mixed.join(classes.select("rep", *_BITS), "rep").withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(denominator / numerator)) + 1e-9))
    x, y = (mixed.select(*(F.col(c).alias(f"{c}_{side}") for c in ("key", "rep", "n", "comp", "class", *_BITS))) for side in "ab")
    y = y.withColumn("near", F.explode(F.array(*(F.col("class_b") + d for d in (-1, 0, 1)))))
    sized = f"{denominator} * least(n_a, n_b) >= {numerator} * greatest(n_a, n_b)"
    differ = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in _BITS)
    near = f"({denominator} + {numerator}) * ({differ}) <= ({denominator} - {numerator}) * (n_a + n_b)"
    met = x.join(y, F.expr(f"key_a = key_b and class_a = near and rep_a < rep_b and comp_a <> comp_b and {sized} and {near}"))
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb"))
