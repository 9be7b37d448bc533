"""The queries of this subpackage: thin selections over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, hard_negatives, html_extract, jaccard_join, language, near_dedup, oracles, quality, secrets, source_divergence, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary()
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, ["doc_id"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.with_predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_predictions(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"]))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, "vec_id % 50 = 0")


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_bpe, op3_toxicity, op4_near_dedup, op5_decontamination, op6_quality, op7_substring_dedup, op8_language, op9_html_extract, op10_secrets, op11_jaccard_join, op12_source_divergence, op13_hard_negatives)}

#: BPE, models and spans with code-point places are held against plain Python in the tests instead.
ORACLES: dict[str, str] = {
    "op1_chat_formatting": oracles.CHAT,
    "op4_near_dedup": oracles.NEAR_DEDUP,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op6_quality": oracles.quality(quality.RULES, quality.BASE, quality.STOP_WORDS),
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_jaccard_join": oracles.JACCARD_JOIN,
    "op12_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
