"""Sinks. Each write replaces what it is about, so that a second run changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(chunks: DataFrame, root: str, kind: str = "json") -> None:
    """Chunks by segment, the timeless ones under ``timeless``; only the segments in ``chunks`` are replaced.

    Chunks with a ``game_name`` go by game, then by segment. Rows of a segment are spread over tasks as they
    come: a hot segment isn't shuffled into one file.
    """
    by = (["game_name"] if "game_name" in chunks.columns else []) + ["segment_key"]
    key = F.when(F.col("segment_id") == -1, "timeless").otherwise(F.col("segment_id").cast("string"))
    chunks.withColumn("segment_key", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(root)


def write_qa(qa: DataFrame, root: str) -> None:
    """QA pairs as JSON lines; the segments in ``qa`` are replaced as a whole."""
    qa.withColumn("segment", F.col("segment_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").json(root)


def write_results(results: DataFrame, path: str) -> None:
    """Retrieval or generation results as JSON lines."""
    results.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str, by: str | None = None) -> None:
    """Metric rows as JSON, in a folder for each value of ``by``."""
    writer = metrics.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_index(postings: DataFrame, stats: DataFrame, weights: DataFrame, root: str, fingerprint: str) -> None:
    """An inverted index as Parquet, in a folder of what it was built from: postings by scope, statistics, weights.

    The manifest is written last: until then an earlier index stands whole.
    """
    folder = f"{root}/{fingerprint}"
    postings.write.mode("overwrite").partitionBy("scope").parquet(f"{folder}/postings")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
    weights.write.mode("overwrite").parquet(f"{folder}/weights")
    postings.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def corpus_fingerprint(docs: DataFrame, *columns: str) -> str:
    """A hash of all rows, whatever their order, that tells whether an index is of this corpus."""
    row = docs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 31))).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def index_is_current(spark, root: str, fingerprint: str) -> bool:
    """Whether the index at ``root`` was built from the corpus of this fingerprint."""
    from tidemark.sources.readers import exists

    return exists(spark, f"{root}/manifest") and not spark.read.schema("fingerprint string").json(f"{root}/manifest").where(F.col("fingerprint") == fingerprint).isEmpty()


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """The ranked board as one small JSON file."""
    board.coalesce(1).write.mode("overwrite").json(path)


def write_submissions(submissions: DataFrame, path: str) -> None:
    """A JSON file for each row, all in one folder.

    The time goes into files, not bytes: small rows are dealt out to as many tasks as there are shuffle partitions,
    and tasks put their files in place themselves, so that neither one task nor the driver handles them all.
    """
    tasks = int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = submissions.repartition(tasks).write.mode("overwrite").option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def write_progress(progress: DataFrame, path: str) -> None:
    progress.coalesce(1).write.mode("overwrite").json(path)


def delete(spark, path: str) -> None:
    """Remove an index or the outputs of a segment, if there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def markdown_report(report: DataFrame) -> DataFrame:
    """One text row for each line of a Markdown table of an aggregate, in the order of its first column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in report.columns)), F.lit(" |"))
    return report.orderBy(report.columns[0]).select(cells.alias("line"))


def run_name(kind: str, model: str) -> str:
    """The name of a run from what it does and its model: ``generation_org_model_7b``."""
    return f"{kind}_{model.replace('/', '_').replace('-', '_')}"


def summary_report(retrieval: DataFrame, generation: DataFrame) -> DataFrame:
    """Text rows (part, position, line) of a summary: retrieval (metric, value), then generation (metric, value, counted, total)."""
    from tidemark.functions.text import summary_line

    head = retrieval.sparkSession.createDataFrame([(0, "", "Retrieval"), (1, "", "Generation")], "part int, position string, line string")
    first = retrieval.select(F.lit(0).alias("part"), F.col("metric").alias("position"), summary_line(F.col("metric"), F.col("value")).alias("line"))
    second = generation.select(F.lit(1).alias("part"), F.col("metric").alias("position"), summary_line(F.col("metric"), F.col("value"), F.col("counted"), F.col("total")).alias("line"))
    return head.union(first).union(second).orderBy("part", "position")
