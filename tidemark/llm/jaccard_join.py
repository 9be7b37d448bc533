"""Exact similarity join of word-shingle sets in the metric space of the Jaccard distance.

Two sets without a common element are at distance 1, and so are nearly all pairs of a corpus: distances to a few pivots
of the whole corpus tell nothing. So the space is cut first: with elements in a fixed order, rare ones first, two sets
within the radius share one of each set's first ones (as many as it may lack, and one more). Elements that a single set
has can't be shared, which leaves most sets of a corpus without a region at all. The others form a region for each pivot:
the member of an element's list that meets the most others stands for the list, and all lists of one pivot are one region.

Distances to the pivot follow exactly. Members within the radius are links; others are held against each other only
if their distances to the pivot differ by no more than the radius (triangle inequality). Regions that are still large
and of more than one component get pivots of their own: every member goes to its nearest pivot's cell (Voronoi) and also
to each cell whose pivot is no more than twice the radius further away, in which its partners may be, and the cells are
joined in the same way again. A region as narrow as these windows, such as a group of near copies, can't be cut: there
the members that aren't in its main component are held against some of that component's. What is left is compared
within its cell, the main component's members never with each other, under windows on sizes and distances and on the
bits in which bitmaps of the sets differ; full sets confirm every link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import discard, materialize, release
from ._words import mix, text_slices, word_hashes, words

WIDTH, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Elements below this hash come first, those that few sets have before others: only their sets are counted. Others follow by hash.
COUNTED = np.uint64(1 << 62)
#: Members of a region that stay without pivots of their own, pivots of a larger one, and how often a region is cut at most.
CELL, PIVOTS, LEVELS = 64, 24, 4
#: Pairs left to compare up to which no region is cut, and the share of them that a cut must do away with for another one to follow.
FEW_PAIRS, PROGRESS = 500_000, 0.5
#: A region is narrow if half of its members are within so many radii of its pivot; a cut that makes more than so many rows of one is no gain.
NARROW, GAIN = 3, 2
#: Members of a region that are dealt out together.
PART = 256
BROADCAST_IDS = 500_000
BITMAP = 32
_BITS = [f"s{k}" for k in range(BITMAP)]
#: What rounding may add to a distance.
EPSILON = 1e-9


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; fewer words are one run."""
    n = min(width, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + mix(hashes[k : len(hashes) - n + 1 + k] + np.uint64(k))
    return np.unique(mix(out))


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, set) of every text; None without words."""
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        for i in range(hi - lo):
            yield lo + i, shingle_set(hashes[at[i] : at[i + 1]], width) if at[i] < at[i + 1] else None


def _lists(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes()).digest()


def _sign(width: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            n, counted, first, keys, digests = [], [], [], [], []
            for _, found in _sets(batch.column(1), width):
                found = none if found is None else found
                size, low = len(found), int(np.searchsorted(found, COUNTED))
                least = size - -(-numerator * size // denominator) + 1 if size else 0
                n.append(size)
                counted.append(low)
                first.append(least)
                keys.append(found[: max(low, least)])
                digests.append(_digest(found) if size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(counted, pa.int64()), pa.array(first, pa.int64()), _lists(keys)], ["doc_id", "n", "digest", "counted", "first", "keys"])
            release()

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch.column(0), width) if s is not None]
            bits = np.zeros((len(found), 64 * BITMAP), np.uint8)
            for k, s in enumerate(found):
                bits[k, (s % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
            longs = np.packbits(bits, axis=1).view(np.int64).reshape(len(found), BITMAP)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), _lists(found), *(pa.array(longs[:, k]) for k in range(BITMAP))], ["digest", "n", "set", *_BITS])
            release()

    return run


def _few(ids: DataFrame) -> DataFrame:
    """For a join on ids: broadcast if they are few, by count."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _members(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cls): the first elements of each class's set that another class's first ones may share."""
    copies = signed.select("row", "digest").where("digest is not null").join(classes.select("digest", "cls"), "digest").where("row <> cls").select(F.col("row").alias("cls"))
    one = signed.where("doc_id is not null and n > 0").withColumnRenamed("row", "cls")
    copies = materialize(copies, "copies")
    if copies.count() <= BROADCAST_IDS:
        one = one.join(F.broadcast(copies), "cls", "left_anti")
    else:
        one = one.join(classes.select("cls"), "cls", "left_semi")
    keys = one.select("cls", (F.col("first") - F.col("counted")).cast("int").alias("more"), F.explode("keys").alias("key"))
    shared = keys.select("key").groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    low = f"key >= 0 and key < {int(COUNTED)}"
    rows = keys.join(shared, "key").withColumn("df", F.when(F.expr(low), F.col("df")).otherwise(F.lit(2**62)))
    own = rows.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("k"), F.count_if(F.expr(low)).alias("again"), F.first("more").alias("more"))
    left = F.greatest(F.lit(0), F.col("more") + F.col("again")).cast("int")
    return own.select("cls", F.explode(F.slice("k", F.lit(1), left)).alias("k")).select("k.key", "cls")


def _distances(members: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """(region, cls, to): of every member (region, cls), the pivots (region, pivot) of its region as an array of (d, pivot, linked).

    A member's set is sent once to its region, and the pivots' sets once to each part of a region.
    """
    sizes = members.groupBy("region").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    held = pivots.join(sets.select(F.col("cls").alias("pivot"), "n", "set"), "pivot").groupBy("region").agg(F.collect_list(F.struct("pivot", "n", "set")).alias("pivots"))
    held = held.join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots")
    own = members.select("region", "cls").join(sizes, "region").select("region", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), "cls")
    own = sets.select("cls", "n", "set").join(_few(own), "cls")

    def distance(p):
        both = F.size(F.array_intersect(F.col("set"), p["set"])).cast("long")
        return F.struct(both.alias("both"), (F.col("n") + p["n"] - both).alias("all"), p["pivot"].alias("pivot"))

    met = own.join(held, ["region", "part"]).select("region", "cls", F.transform("pivots", distance).alias("t"))
    return met.select("region", "cls", F.transform("t", lambda t: F.struct((1 - t["both"] / t["all"]).alias("d"), t["pivot"].alias("pivot"), t["both"].alias("both"), t["all"].alias("all"))).alias("to"))


def _links(found: DataFrame, numerator: int, denominator: int) -> DataFrame:
    t = found.select("cls", F.explode("to").alias("t")).where(f"{denominator} * t.both >= {numerator} * t.all and cls <> t.pivot")
    return t.select(F.least("cls", "t.pivot").alias("a"), F.greatest("cls", "t.pivot").alias("b")).distinct()


def _mixed(regions: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the regions (region, cls, d, native) that hold more than one component, with ``comp``, the region's ``main`` one and its ``size``."""
    comp = materialize(components(links, by_stars=True), "components")
    now = regions.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    now = materialize(now, "members")
    own = now.groupBy("region", "comp").agg(F.count("*").alias("n"))
    several = own.groupBy("region").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).where("m.n < size").select("region", F.col("m.comp").alias("main"), "size")
    out = materialize(now.join(several, "region"), "mixed")
    discard(comp, now)
    return out


def _left(mixed: DataFrame) -> float:
    """How many pairs of a region's members outside of its main component and all of its members there are."""
    own = mixed.groupBy("region").agg((F.count("*").cast("double") * F.count_if(F.col("comp") != F.col("main"))).alias("pairs"))
    return own.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()["pairs"]


def _some(members: DataFrame, level: int) -> DataFrame:
    """(region, pivot): some members of each region, which a hash chooses."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("cls", F.lit(level)), "cls"))
    return members.select("region", "cls").withColumn("r", rank).where(F.col("r") <= PIVOTS).select("region", F.col("cls").alias("pivot"))


def _voronoi(found: DataFrame, large: DataFrame, radius: float) -> DataFrame:
    """Members (region, cls, d, native) of the pivots' cells: each in its nearest one, and in those that may hold partners.

    A region that its pivots don't part stays as it is.
    """
    near = found.withColumn("near", F.array_min("to"))
    cells = near.withColumn("in", F.filter("to", lambda t: t["d"] <= F.col("near.d") + 2 * radius + EPSILON))
    gain = cells.groupBy("region").agg((F.sum(F.size("in")) <= GAIN * F.count("*")).alias("parted"))
    gain = materialize(gain, "gain")
    cut = cells.join(gain.where("parted").select("region"), "region").select("region", "cls", "near", F.explode("in").alias("t"))
    cut = cut.select(F.concat_ws("/", "region", F.col("t.pivot").cast("string")).alias("region"), "cls", F.col("t.d").alias("d"), (F.col("t.pivot") == F.col("near.pivot")).alias("native"))
    return cut.unionByName(large.join(gain.where("parted").select("region"), "region", "left_anti").select("region", "cls", "d", "native"))


def _cut(mixed: DataFrame, sets: DataFrame, level: int, radius: float, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(links, regions): large regions cut by pivots of their own or, where they are narrow, held against some of their main component."""
    width = mixed.where(F.col("size") > CELL).groupBy("region").agg((F.avg((F.col("d") <= NARROW * radius).cast("int")) >= 0.5).alias("narrow"))
    large = materialize(mixed.join(width, "region"), "large")
    wide, narrow = large.where("not narrow"), large.where("narrow")
    found = materialize(_distances(wide, _some(wide, level), sets), "distances")
    probed = materialize(_distances(narrow.where("comp <> main"), _some(narrow.where("comp = main"), level), sets), "probed")
    links = _links(found, numerator, denominator).union(_links(probed, numerator, denominator)).distinct()
    rest = mixed.where(F.col("size") <= CELL).unionByName(narrow.drop("narrow")).select("region", "cls", "d", "native")
    out = materialize(links, "links"), materialize(_voronoi(found, wide, radius).unionByName(rest), "regions")
    discard(large, found, probed)
    return out


def _pairs(mixed: DataFrame, sets: DataFrame, radius: float, numerator: int, denominator: int) -> DataFrame:
    """(a, b) of a region whose components differ and whose sizes, distances to the pivot and bitmaps allow a link.

    The members outside of a region's main component meet all of its members, dealt out in parts.
    """
    rows = mixed.withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).join(sets.select("cls", "n", *_BITS), "cls")
    columns = ["region", "cls", "n", "comp", "d", "native", *_BITS]
    x = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    y = rows.where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = (df.select(F.col("part").alias(f"part_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for df, side in ((x, "a"), (y, "b")))
    differ = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in _BITS)
    met = x.join(y, F.expr(f"""region_a = region_b and part_a = part_b and comp_a <> comp_b and (native_a or native_b)
        and {denominator} * least(n_a, n_b) >= {numerator} * greatest(n_a, n_b) and abs(d_a - d_b) <= {radius + EPSILON}
        and ({denominator} + {numerator}) * ({differ}) <= ({denominator} - {numerator}) * (n_a + n_b)"""))
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose whole sets are similar enough: those of one first document are a region with that pivot."""
    found = _distances(pairs.select(F.col("a").cast("string").alias("region"), F.col("b").alias("cls")), pairs.select(F.col("a").cast("string").alias("region"), F.col("a").alias("pivot")).distinct(), sets)
    return _links(found, numerator, denominator)


def similarity_components(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are linked when ``denominator * |A & B| >= numerator * |A | B|`` over lower-cased (A-Z) shingles of ``width``
    words, which 64-bit hashes stand for. No link between different texts is missed: the join is exact. Null,
    empty and blank texts have no shingles and are linked with nothing. Rows that repeat a doc_id are returned
    each, with the component of their own text. Rows with a null doc_id are returned with a null component and link
    nothing. An empty table gives an empty result.
    """
    radius = 1 - numerator / denominator
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.mapInArrow(_sign(width, numerator, denominator), "doc_id long, n long, digest binary, counted long, first long, keys array<long>")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = signed.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("h")).select("digest", F.col("h.row").alias("cls"), F.col("h.doc_id").alias("least"))
    classes = materialize(classes, "classes")
    members = materialize(_members(signed, classes), "members")
    # the pivot of a list is the member that meets the most others in all of its lists; edited copies have that in their source
    lists = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(members.join(lists, "key"), "met")
    pivots = met.groupBy("cls").agg(F.sum("size").alias("met"))
    pivots = met.join(pivots, "cls").groupBy("key").agg(F.min(F.struct(-F.col("met"), "cls")).alias("h")).select("key", F.col("h.cls").alias("pivot"))
    regions = materialize(met.join(pivots, "key").select(F.col("pivot").cast("string").alias("region"), "pivot", "cls").distinct(), "regions")
    wanted = materialize(regions.select("cls").distinct().join(classes, "cls"), "wanted")
    ids = _few(wanted.select(F.col("least").alias("doc_id")).distinct())
    whole = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_whole(width), "digest binary, n long, set array<long>, " + ", ".join(f"{b} long" for b in _BITS))
    sets = materialize(whole.join(_few(wanted.select("digest", "cls")), "digest").drop("digest"), "sets")
    if sets.count() > wanted.count():  # rows that repeat a doc_id and its text
        sets = materialize(sets.dropDuplicates(["cls"]), "sets")
    found = materialize(_distances(regions, regions.select("region", "pivot").distinct(), sets), "distances")
    links = materialize(_links(found, numerator, denominator), "links")
    now = materialize(found.select("region", "cls", F.col("to")[0]["d"].alias("d"), F.lit(True).alias("native")), "regions")
    discard(members, met, found)
    before = float("inf")
    for level in range(1, LEVELS + 1):
        mixed = _mixed(now, links)
        left = _left(mixed)
        if level == LEVELS or left <= FEW_PAIRS or left > (1 - PROGRESS) * before:
            break
        before = left
        more, cut = _cut(mixed, sets, level, radius, numerator, denominator)
        both = materialize(links.union(more).distinct(), "links")
        discard(links, more, now, mixed)
        links, now = both, cut
    pairs = materialize(_pairs(mixed, sets, radius, numerator, denominator), "pairs")
    links = materialize(links.union(_confirmed(pairs, sets, numerator, denominator)), "links")
    component = components(links, by_stars=True).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    named = materialize(classes.join(component, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "comp").select("digest", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
