"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge goes from a node of no other edge to the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame, by_stars: bool = False) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b).

    Every round is two aggregations and two joins on the node; hubs are pre-aggregated before each
    shuffle and their rows are dealt out by the skew join. Rounds grow with the logarithm of the longest
    path. An empty edge table gives an empty result; loops and repeated edges change nothing. The last round is the one
    that changes nothing or, with ``by_stars``, the one before it, which leaves stars.
    """
    start = edges.select("a", "b") if not by_stars else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(start.where("a <> b").distinct(), "edges")
    seen = None
    while not (by_stars and _are_stars(now)):
        if not by_stars:
            total = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
            if total == seen or not total["n"]:
                break
            seen = total
        before, now = now, materialize(_small_star(_large_star(now).where("a <> b")).where("a <> b").distinct(), "edges")
        discard(before)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, component) under more ``links`` (a, b): these are followed between components, not between nodes."""
    to = found.select("node", "component")
    ends = links.join(to.toDF("a", "of_a"), "a", "left").join(to.toDF("b", "of_b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    of = materialize(components(ends, by_stars=True), "of")
    moved = found.join(of.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(of.join(found, "node", "left_anti"))
