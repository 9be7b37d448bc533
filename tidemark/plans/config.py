"""Settings of the plans, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CorpusConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200


@dataclass(frozen=True)
class RetrievalConfig:
    retriever: str = "bm25"
    k: int = 3
    k1: float = 1.2
    b: float = 0.75
    scope: str = "game_name"
    include_timeless: bool = True

    @property
    def model_key(self) -> str:
        return f"{self.retriever}_k{self.k}"


@dataclass(frozen=True)
class GenerationConfig:
    target: int = 500
    similarity_threshold: float = 0.3
    quality_least: int = 1
    batch: int = 100
    tries: int = 3


def load(kind: type, text: str):
    """A configuration from JSON text; settings that it doesn't have are left out."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in json.loads(text).items() if k in known})


def as_column(config):
    """The configuration as a struct of constants, to stand in every row of a result."""
    return F.struct(*(F.lit(v).alias(k) for k, v in asdict(config).items()))


def segment_info(spark: SparkSession, segments: DataFrame, segment: int) -> dict:
    """The dates of one segment, ``unknown`` where it isn't listed."""
    row = segments.where(F.col("segment_id") == segment).select("start_date", "end_date").first()
    return {"segment_id": segment, "start_date": row["start_date"] if row else "unknown", "end_date": row["end_date"] if row else "unknown"}
