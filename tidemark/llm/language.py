"""Language identification by compression.

Each language has a zstandard raw-content dictionary, filled with pieces of its labelled texts. A text is cut
into pieces of ``PIECE`` bytes, every piece is compressed with the dictionary of each language, and the
language whose sizes add up to the least wins. A win by less than ``MIN_MARGIN`` bytes is marked as rejected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import held, materialize, widened

#: Texts of a language, characters of one text, and bytes of a dictionary that are learned from at most.
MAX_ROWS, ROW_CHARS, DICT_BYTES = 900, 1024, 1 << 17
#: Languages whose dictionaries tasks hold at a time (32 MB); the texts go through those of more languages shard by shard.
MAX_LANGUAGES = 256
#: Languages up to which their sample's bounds are broadcast.
BROADCAST_LANGUAGES = 100_000
#: Bytes that are compressed at a time, and the level, for texts of every size.
PIECE, LEVEL = 4096, 6
MIN_MARGIN = 4


Model = list[tuple[str, bytes]]


class Shards:
    """Dictionaries of more languages than tasks hold: a table of pieces, read MAX_LANGUAGES languages at a time."""

    def __init__(self, pieces: DataFrame, n: int):
        self.pieces, self.n = pieces, n

    def __iter__(self) -> Iterator[Model]:
        for lo in range(0, self.n, MAX_LANGUAGES):
            yield _contents(self.pieces.where((F.col("rank") > lo) & (F.col("rank") <= lo + MAX_LANGUAGES)))


def _contents(pieces: DataFrame) -> Model:
    picked = pieces.orderBy("rank", "k").select("rank", "lang", "piece").toPandas()  # MAX_LANGUAGES times DICT_BYTES at most
    return [(own["lang"].iloc[0], "\n".join(own["piece"]).encode()) for _, own in picked.groupby("rank", sort=True)]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | Shards:
    """(language, dictionary content) from ``docs`` (text, lang); the most frequent language comes first.

    Different texts of a language are taken in the order of a hash, and of each a piece of ROW_CHARS, as long as
    the pieces fit into DICT_BYTES (some 128 long ones) and up to ``max_rows``; copies of a text count once.
    Rows without a language or a letter are left out. There may be any number of languages: of more than
    MAX_LANGUAGES the model is a table that is read in shards.
    """
    rows = docs.select("lang", "text").where("lang is not null and text rlike '\\\\p{L}'")
    hashed = rows.select("lang", F.xxhash64("text", F.lit(1)).alias("at"))
    texts = hashed.groupBy("lang", "at").agg(F.count("*").alias("n"))
    counts = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "lang"))  # a row a language
    bound = F.when(F.col("texts") <= 2 * max_rows, F.lit(2**63 - 1)).otherwise((F.lit(float(-(2**63))) + F.lit(float(2**64)) * (F.lit(2.0 * max_rows) / F.col("texts"))).cast("long"))
    languages = materialize(counts.select("lang", rank.alias("rank"), bound.alias("bound")), "languages")
    n = languages.count()
    languages = F.broadcast(languages) if n <= BROADCAST_LANGUAGES else languages
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - ROW_CHARS // 2, F.lit(1))).cast("int")
    rows = rows.select("lang", F.xxhash64("text", F.lit(1)).alias("at"), F.lower(F.substring("text", at + 1, F.lit(ROW_CHARS))).alias("piece"))
    rows = rows.join(languages, "lang").where("at <= bound").groupBy("rank", "lang", "at").agg(F.min("piece").alias("piece"))
    first = Window.partitionBy("rank").orderBy("at")
    picked = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max_rows)
    upto = F.sum(F.octet_length("piece") + 1).over(first.rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("upto", upto).where(F.col("upto") <= DICT_BYTES).select("rank", "lang", "k", "piece")
    return _contents(picked) if n <= MAX_LANGUAGES else Shards(materialize(picked, "pieces"), n)


class Compressors:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, model: Model):
        self.languages = [lang for lang, _ in model]
        self.compressors = [self._compressor(content) for _, content in model]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "surrogatepass")
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors])


def _classify(shared, at: int, kept: list[int], min_margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = held(("language", hash(tuple(shared.value))), lambda: Compressors(shared.value))
        for batch in batches:
            langs, scores, accepted = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                if not text or not compressors.languages or not any(map(str.isalpha, text)):
                    langs.append("und"), scores.append(0.0), accepted.append(False)
                    continue
                sizes = compressors.sizes(text)
                best = int(sizes.argmin())
                margin = int(np.delete(sizes, best).min() - sizes[best]) if len(sizes) > 1 else min_margin
                langs.append(compressors.languages[best])
                scores.append(1 - 0.5 ** ((margin + 1) / 4))
                accepted.append(margin >= min_margin)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(langs), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], [*(batch.schema.names[k] for k in kept), "lang_pred", "score", "accepted"])

    return run


def _refine(shared, names: tuple[str, str, str]):
    """Batches whose last column is the text, with the least size so far, its language and the next larger size, after one more shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = held(("language", hash(tuple(shared.value))), lambda: Compressors(shared.value))
        for batch in batches:
            at = [batch.schema.names.index(c) for c in (*names, "text")]
            best, lang, second = (batch.column(k).to_pylist() for k in at[:3])
            for i, text in enumerate(batch.column(at[3])):
                text = text.as_py()
                if not text or not any(map(str.isalpha, text)):
                    continue
                for name, size in zip(compressors.languages, compressors.sizes(text).tolist()):
                    if best[i] is None or size < best[i]:
                        best[i], lang[i], second[i] = size, name, best[i]
                    elif second[i] is None or size < second[i]:
                        second[i] = size
            new = {at[0]: pa.array(best, pa.int64()), at[1]: pa.array(lang, pa.string()), at[2]: pa.array(second, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(k, batch.column(k)) for k in range(batch.num_columns)], batch.schema.names)

    return run


def _by_shards(docs: DataFrame, shards: Iterator[Model], min_margin: int, columns: list[str]) -> DataFrame:
    """As ``identify``: each shard is one pass over the texts, which hands on the two least sizes."""
    names = tuple(next(n for n in (c, f"_{c}", f"__{c}") if n not in docs.columns) for c in ("best", "best_lang", "second"))
    kinds = ("long", "string", "long")
    now = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds)})
    for shard in shards:
        shared = docs.sparkSession.sparkContext.broadcast(shard)  # MAX_LANGUAGES times DICT_BYTES at most
        now = materialize(now.mapInArrow(_refine(shared, names), now.schema), "languages")
    best, lang, second = map(F.col, names)
    margin = F.coalesce(second - best, F.lit(min_margin))
    score = F.when(best.isNull(), 0.0).otherwise(1 - F.pow(F.lit(0.5), (margin + 1) / 4))
    return now.select(*columns, F.coalesce(lang, F.lit("und")).alias("lang_pred"), score.alias("score"), (best.isNotNull() & (margin >= min_margin)).alias("accepted"))


def identify(docs: DataFrame, model: Model | Shards, min_margin: int = MIN_MARGIN, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``lang_pred``, ``score`` (0 to 1, from the margin in bytes) and ``accepted``.

    Whole texts are read. Texts that are null, empty or without a letter are ``und`` with a score of 0; so are
    all texts under an empty model. Of equal sizes the more frequent language wins, with a margin of 0, which
    is rejected. Columns of these names are replaced. More than MAX_LANGUAGES languages are tried shard by shard, with
    the same result.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    columns = [c for c in columns or docs.columns if c in docs.columns]
    if isinstance(model, Shards) or len(model) > MAX_LANGUAGES:
        shards = model if isinstance(model, Shards) else (model[k : k + MAX_LANGUAGES] for k in range(0, len(model), MAX_LANGUAGES))
        return _by_shards(docs, shards, min_margin, columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES times DICT_BYTES at most
    fn = _classify(shared, docs.columns.index("text"), [docs.columns.index(c) for c in columns], min_margin)
    return docs.mapInArrow(fn, widened(docs.select(columns), lang_pred="string", score="double", accepted="boolean"))


def with_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), learned from the rows that aren't held out.

    A row is held out when crc32 of its doc_id as text leaves 1 on division by 3; a null doc_id isn't.
    """
    outside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~outside).select("lang", "text"))
    found = identify(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return found.select("doc_id", outside.alias("held_out"), "lang_pred", "score", "accepted")


def dump(model: Model) -> str:
    """A fitted model as JSON text."""
    return json.dumps([[lang, content.hex()] for lang, content in model])


def load(text: str) -> Model:
    """The model of ``dump``."""
    return [(lang, bytes.fromhex(content)) for lang, content in json.loads(text)]
