"""Scans. Paths go to Spark's readers alone, so that any store they know will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import schemas as S
from tidemark.sources.scratch import kept


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, a folder or anything that a glob matches is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(p) or []) > 0


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` from JSON in ``value``; blank and broken texts are no rows. Other columns stay."""
    options = {"columnNameOfCorruptRecord": "_broken"}
    out = rows.where("trim(value) <> ''").withColumn("_j", F.from_json("value", f"{schema}, _broken STRING", options))
    return out.where("_j is not null and _j._broken is null").select(*(c for c in rows.columns if c != "value"), "_j.*").drop("_broken")


def _jsonl(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON lines of a schema. Blank lines are no rows; in PERMISSIVE mode broken lines go, in FAILFAST they fail."""
    if mode == "FAILFAST":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _parsed(spark.read.text(path), schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(position, segment_id, start_date, end_date, type_distribution); a file without ``segments`` has none."""
    rows = spark.read.schema(f"segments ARRAY<STRUCT<{_struct(S.SEGMENT)}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("segments").alias("position", "s")).select("position", "s.*")


def _struct(ddl: str) -> str:
    out, depth = [], 0
    part = ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def read_source_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, title, file_type, file_size, text) of all .txt and .md files below ``root``, one row a file.

    The title is the file's name without these endings. Files that can't be read are skipped.
    """
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").option("ignoreCorruptFiles", True).text(root)
    name = F.col("_metadata.file_name")
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace(name, r"\.(txt|md)", "").alias("title"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("file_type"), F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("text"))


#: Splits of files up to which what is known of each is broadcast.
BROADCAST_SPLITS = 100_000


def numbered(lines: DataFrame, by: list[str], name: str = "line", needed: Column | None = None) -> DataFrame:
    """``lines`` (a scan of text files) with the number of each line among those of its ``by`` columns, from 1: files by path, lines as they stand.

    Files may be split anywhere. Lines are counted by split, the counts before a split are summed up over splits, and
    a line's place in its own split is added: no file is read by a single task, and no line is shuffled. Lines that
    aren't ``needed`` may get a null: where no line is, the counts are all that is read.
    """
    rows = lines.withColumns({"_file": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()})
    counts = rows.groupBy(*by, "_file", "_split").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"), F.count_if(F.lit(True) if needed is None else needed).alias("_needed"))
    counts = kept(counts, "splits")
    known = counts.agg(F.count("*").alias("splits"), F.sum("_needed").alias("needed")).first()
    if not known["needed"]:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_file", "_split", "_place")
    before = Window.partitionBy(*by).orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_file", "_split", "_first", "_before")
    counts = F.broadcast(counts) if known["splits"] <= BROADCAST_SPLITS else counts
    out = rows.join(counts, ["_file", "_split"]).withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_file", "_split", "_place", "_first", "_before")


def read_corpus(spark: SparkSession, root: str, segment: int | None = None, timeless: bool = True, game: str | None = None) -> DataFrame:
    """Chunks of a corpus written by segment: one segment or all, with or without the timeless ones.

    The segment, and the game of a corpus of several, are partition columns, so only the folders asked for are
    read. A row without an id gets ``segment_{n}_doc_{line}`` (or ``timeless_doc_{line}``), its line being counted over
    the files of its segment (and game), blank and broken ones included; the text is ``contents``, else ``text``.
    """
    rows = spark.read.text(root).withColumn("segment_key", F.col("segment_key").cast("string"))
    by = ["segment_key"] + (["game_name"] if "game_name" in rows.columns else [])
    if game is not None:
        rows = rows.where(F.col("game_name").cast("string") == game)
    if segment is not None:
        rows = rows.where(F.col("segment_key").isin(str(segment), "timeless") if timeless else F.col("segment_key") == str(segment))
    elif not timeless:
        rows = rows.where("segment_key <> 'timeless'")
    rows = numbered(rows, by, "_line", F.get_json_object("value", "$.id").isNull() & (F.trim("value") != ""))
    source = F.when(F.col("segment_key") == "timeless", F.col("segment_key")).otherwise(F.concat(F.lit("segment_"), "segment_key"))
    rows = _parsed(rows.withColumn("_own", F.concat_ws("_", source, F.lit("doc"), "_line")).drop("_line"), S.CHUNK)
    return rows.withColumn("id", F.coalesce("id", "_own")).withColumn("text", F.coalesce("contents", "text", F.lit(""))).drop("contents", "_own")


def read_qa(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """QA pairs as JSON lines, broken lines skipped. A missing path is an empty table, or an error if ``required``.
    ``required`` also drops blank questions."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], S.QA)
    rows = _jsonl(spark, path, S.QA)
    return rows.where("trim(question) <> ''") if required else rows


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """QA pairs as CSV with JSON in the cells of references, retrieved_docs and entities; a bad cell is an empty list."""
    rows = spark.read.schema(S.QA_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cell = lambda name, kind: F.coalesce(F.from_json(name, kind), F.array().cast(kind))
    return rows.withColumns({"references": cell("references", S.EMPTY_LIST), "retrieved_docs": cell("retrieved_docs", S.RETRIEVED), "entities": cell("entities", S.EMPTY_LIST)})


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates; broken lines are skipped."""
    return _jsonl(spark, path, S.TEMPLATE)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas; a broken line fails."""
    return _jsonl(spark, path, S.PERSONA, "FAILFAST")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(position, main, sub, code, description): a row without sub for every main topic, then its sub topics."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", S.TAXONOMY)).alias("position", "main", "m"))
    mains = rows.select("position", "main", F.lit(None).cast("string").alias("sub"), "m.code", "m.description")
    subs = rows.select("position", "main", F.explode("m.subcategories").alias("sub", "s")).select("position", "main", "sub", "s.code", "s.description")
    return mains.union(subs)


def read_task_types(spark: SparkSession, path: str) -> DataFrame:
    """(task_type, requirement); a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "task_type STRING, requirement STRING")
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "MAP<STRING,STRING>")).alias("task_type", "requirement"))


def read_retrieval_results(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval results, with the segment and the model from a name like ``segment_2_model_k3.jsonl`` where it has them."""
    name = F.col("_metadata.file_name")
    rows = spark.read.text(path).withColumn("file_segment", F.regexp_extract(name, r"segment_(\d+)", 1).try_cast("int")).withColumn("file_model", F.nullif(F.regexp_extract(name, r"segment_\d+_(.*?)\.jsonl?$", 1), F.lit("")))
    return _parsed(rows, S.RETRIEVAL)


def read_generation_results(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark, path, S.GENERATION)


def read_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """(file, system_name, description, game, six metrics as text) of every readable ``*.json`` but the example."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).withColumn("file", F.col("_metadata.file_name")).where("file <> 'example_submission.json'")
    return _parsed(rows, S.SUBMISSION).select("file", "system_name", "description", F.explode("games").alias("game", "m")).select("file", "system_name", "description", "game", "m.*")


def read_leaderboard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A leaderboard's rows; none if it is missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _jsonl(spark, path, schema)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A segment's progress; none if it hasn't begun."""
    return _jsonl(spark, path, S.PROGRESS) if exists(spark, path) else spark.createDataFrame([], S.PROGRESS)


def available_segments(spark: SparkSession, root: str) -> DataFrame:
    """(segment_key) of a corpus, from the names of its folders, whether ``segment_key=1`` or ``segment_1``; no file is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(x.getPath().getName()) for x in (fs.listStatus(p) if fs.exists(p) else []) if x.isDirectory()]
    keys = sorted(n.split("=", 1)[1] if n.startswith("segment_key=") else n.removeprefix("segment_") for n in names if n.startswith("segment_"))
    return spark.createDataFrame([(k,) for k in keys], "segment_key string")


def available_games(qa: DataFrame) -> DataFrame:
    return qa.select("game_name").distinct().orderBy("game_name")
