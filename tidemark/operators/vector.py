"""Dense retrieval and persona matching by cosine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import dot

#: Queries that are broadcast against all vectors at a time; more are taken in blocks of so many.
QUERY_BLOCK = 2000
DIGITS = 6


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similarities(queries: DataFrame, vectors: DataFrame, scope: str | None = None) -> DataFrame:
    """(query_id, vec_id, score): each block of queries (query_id, embedding) is broadcast against all vectors (vec_id, embedding).

    The stated query set is met with all rows, or with those of its ``scope`` (a column of both, kept in the
    result); neither side is gathered or sampled. Vectors are brought to length one before they meet, so that
    a pair costs one sum of products. Scores are rounded.
    """
    kept = [scope] if scope else []
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    out, own = None, vectors.select("vec_id", unit(F.col("embedding")).alias("v"), *kept)
    for i in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        asked = F.broadcast(block.select("query_id", unit(F.col("embedding")).alias("q"), *kept))
        met = own.join(asked, scope) if scope else own.join(asked)
        met = met.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")), DIGITS).alias("score"), *kept)
        out = met if out is None else out.union(met)
    return out


def top_k(scored: DataFrame, k: int = 3, threshold: float | None = None) -> DataFrame:
    """With ``rank`` up to ``k``: score descending, then the smaller id; scores under the threshold (null counts as 0) go first."""
    if threshold is not None:
        scored = scored.where(F.coalesce("score", F.lit(0.0)) >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def best_match(scored: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each query, and a null vec_id where it is under ``least``."""
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("minus_id"))).alias("b"))
    return best.select("query_id", F.when(F.col("b.score") >= least, -F.col("b.minus_id")).alias("vec_id"), F.col("b.score").alias("score"))


def write_store(vectors: DataFrame, path: str, fingerprint: str) -> None:
    """Vectors (vec_id, embedding, ...) as Parquet in a folder of what they were made from; it counts once its manifest is there."""
    vectors.write.mode("overwrite").parquet(f"{path}/{fingerprint}")
    vectors.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_or_embed(items: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """The vectors of ``items`` (vec_id, text), read from ``path`` if they are of these very items, else made by ``embed`` and kept.

    ``force`` makes them anew. ``embed`` gets the items and returns (vec_id, embedding).
    """
    from tidemark.sources.writers import corpus_fingerprint, index_is_current

    spark, mark = items.sparkSession, corpus_fingerprint(items, "vec_id", "text")
    if force or not index_is_current(spark, path, mark):
        write_store(embed(items), path, mark)
    return spark.read.parquet(f"{path}/{mark}")


def lookup(found: DataFrame, store: DataFrame, key: str, text: str) -> DataFrame:
    """``found`` with ``content``; an id that the store lacks gets ``Document {id}``."""
    return found.join(store.select(key, F.col(text).alias("content")), key, "left").withColumn("content", F.coalesce("content", F.concat(F.lit("Document "), F.col(key).cast("string"))))


def labelled(**parts: Column) -> Column:
    """``name: value`` for each part that isn't blank, joined by blanks."""
    return F.concat_ws(" ", *(F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in parts.items()))


def persona_text(description: Column, content: Column, topic: Column) -> Column:
    """What stands for a persona when it is embedded."""
    return labelled(description=description, content=content, topic=topic)


def template_text(template: Column, kind: Column, description: Column, topic: Column) -> Column:
    """What stands for a template when it is embedded."""
    return labelled(template=template, kind=kind, description=description, topic=topic)


def personas_by_topic(personas: DataFrame) -> DataFrame:
    """(topic, n_personas, first_persona) from the pipe-separated source_topic of (persona_id, source_topic)."""
    topics = personas.select("persona_id", F.explode(F.split("source_topic", r"\|")).alias("topic")).select("persona_id", F.trim("topic").alias("topic")).where("topic <> ''")
    return topics.groupBy("topic").agg(F.count_distinct("persona_id").alias("n_personas"), F.min("persona_id").alias("first_persona"))


def persona_statistics(personas: DataFrame) -> DataFrame:
    """One row: total personas, and distinct topics in their pipe-separated source_topic."""
    topics = personas.select(F.explode(F.split("source_topic", r"\|")).alias("t")).where("trim(t) <> ''").agg(F.count_distinct(F.trim("t")).alias("total_topics"))
    return personas.agg(F.count("*").alias("total_personas")).join(F.broadcast(topics), F.lit(True))  # one row each
