"""All queries with their DuckDB equivalents, on the driver's tables.

``lang`` stands for the game, ``source`` for the topic, ``benchmark`` items for questions; what a question
should find are the documents that contain its text.
"""

from tidemark.catalog import answers, files, grown, metrics, planning, provided, records, retrieval, text, time  # noqa: F401
from tidemark.catalog.metrics import metrics_overall as flagship
from tidemark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
