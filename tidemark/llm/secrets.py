"""Secret scans over an incremental ledger of content-addressed blobs.

Each historical version of a path is a blob, named by the SHA-256 of its text. The ledger holds one row for
every blob and version of the rules that has been scanned. A run looks up which blobs of its input the
ledger doesn't have, scans one copy of each, appends the findings, and joins them back to all paths.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import held, materialize, shared_dir, until_the_end

# The rules, in the order in which spans of one start are listed. The first three are the base;
# (kind, pattern, group whose length counts, least length). A failed match never goes over a text twice: a key's body ends at
# the next row of dashes and a token's parts are taken whole, from the start of their run.
RULES = (
    ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, False),
    ("hex", r"[0-9a-f]{24,}", 0, 24, False),
    ("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,.-])*+-----END [A-Z ]{0,32}PRIVATE KEY-----", 0, 40, False),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 30, False),
    ("host_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 15, False),
    ("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[^\s/@]+", 0, 10, False),
)
BASE = ("assign", "access", "hex")
# What a text holds, in lower case, if any rule but the one for hex digits is to match; it spares most blobs the way through Python.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key", "akia", "private key", "eyj", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_live_", "://")
HEX_HINT = "[0-9a-f]{24}"
RULE_VERSION = hashlib.sha256(repr((RULES, HINTS, HEX_HINT)).encode()).hexdigest()[:16]
_SPAN = "struct<kind:string,at:int,end:int>"
_LEDGER = f"blob string, rules string, spans array<{_SPAN}>"


def find_spans(text: str, rules=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost without overlaps per kind, in order of start, then of the rules."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules or _compiled()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    found.sort()
    return [(kind, start, end) for start, _, kind, end in found]


def _compiled():
    return [(kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if fold else 0)), group, least) for kind, pattern, group, least, fold in RULES]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("secrets")
    rules = _compiled()
    kind = pa.struct([("kind", pa.string()), ("at", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        spans = [[dict(zip(("kind", "at", "end"), s)) for s in find_spans(t.as_py(), rules)] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["blob", "spans"])


def blobs(versions: DataFrame) -> DataFrame:
    """``versions`` with a column ``blob``, the content address of its text; a null text is the empty blob."""
    return versions.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def hinted(text: str = "text") -> Column:
    """Whether any rule can match the text, which is lower-cased once for all hints; false for null."""
    within = lambda low: functools.reduce(lambda x, y: x | y, (low.contains(h) for h in HINTS))
    return F.coalesce(F.element_at(F.transform(F.array(F.lower(text)), within), 1) | F.col(text).rlike(HEX_HINT), F.lit(False))


def scan_unseen(versions: DataFrame, ledger: str) -> DataFrame:
    """Scan the blobs of ``versions`` (blob, hint, text) that the ledger at path ``ledger`` lacks; the whole ledger of these rules.

    One copy of each unseen blob is scanned, where a partial aggregation has left one before the shuffle;
    texts without any rule's hint are recorded as clean and not sent to Python. The new rows are appended in
    one write, so a lost executor repeats a task and nothing else.
    """
    spark = versions.sparkSession
    known = _read(spark, ledger)
    unseen = versions.select("blob", "hint", "text")
    if known is not None:
        unseen = unseen.join(known.where(F.col("rules") == RULE_VERSION).select("blob"), "blob", "left_anti")
    found = unseen.where("hint").groupBy("blob").agg(F.first("text").alias("text")).mapInArrow(_scan, f"blob string, spans array<{_SPAN}>")
    clean = unseen.where("not hint").select("blob").distinct().select("blob", F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))
    new = found.union(clean).select("blob", F.lit(RULE_VERSION).alias("rules"), "spans")
    new.write.mode("append").parquet(ledger)
    return spark.read.schema(_LEDGER).parquet(ledger).where(F.col("rules") == RULE_VERSION)


def _read(spark, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_LEDGER).parquet(ledger) if there else None


def new_ledger(spark) -> str:
    """A path for a ledger of one run, in the shared folder; it goes when the driver ends."""
    import uuid

    return until_the_end(spark, f"{shared_dir(spark)}/tidemark-ledger-{uuid.uuid4().hex}")


def scan(docs: DataFrame, ledger: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``blob`` and ``spans`` (kind, at, end): what the rules find in every text.

    ``ledger`` is the path of a table that outlives the run; without one, a new ledger is kept in the shared
    folder. ``docs`` is read once: what is returned and the texts with a hint are written for the steps after.
    Null texts count as empty and have no spans; whole texts are scanned, in time that grows with their length. Repeated rows and equal texts share one scan. Columns of
    ``docs`` named blob or spans are replaced. An empty table gives an empty result.
    """
    columns = [c for c in columns or docs.columns if c not in ("blob", "spans")]
    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]  # the names of docs may be any
    hint = hinted()
    text = F.when(hint, F.col("text")).alias("text")
    versions = materialize(blobs(docs.drop("blob")).select(*kept, "blob", hint.alias("hint"), text), "versions")
    ledger = scan_unseen(versions, ledger or new_ledger(docs.sparkSession))
    # only blobs with findings are joined back; a ledger can hold a blob twice if two runs met
    found = ledger.where("size(spans) > 0").groupBy("blob").agg(F.first("spans").alias("spans"))
    found = materialize(found, "findings")
    out = versions.drop("hint", "text").join(found, "blob", "left")
    spans = F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("spans")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), "blob", spans)


def redact(docs: DataFrame, ledger: str | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span, and what spans cover together, replaced by ``mask``; all columns and rows stay."""
    columns = docs.columns
    hint = hinted()
    own = {c: f"_own_{c}" for c in ("blob", "spans") if c in columns}  # columns of these names are not the scan's
    found, rest = scan(docs.where(hint).withColumnsRenamed(own), ledger), docs.where(~hint)
    # spans are in order of their starts: join the overlapping ones, then cut the text between them
    joined = """aggregate(spans, cast(array() as array<struct<at:int,end:int>>), (s, v) -> if(size(s) > 0 and element_at(s, -1).end >= v.at,
        concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).at as at, greatest(element_at(s, -1).end, v.end) as end))),
        concat(s, array(struct(v.at as at, v.end as end)))))"""
    found = found.withColumn("spans", F.expr(joined))
    cut = F.expr("transform(sequence(0, size(spans)), k -> substring(text, if(k = 0, 1, spans[k - 1].end + 1), if(k = size(spans), length(text), spans[k].at) - if(k = 0, 0, spans[k - 1].end)))")
    found = found.withColumn("text", F.when(F.size("spans") > 0, F.array_join(cut, mask)).otherwise(F.col("text")))
    return found.select(*(F.col(own.get(c, c)).alias(c) for c in columns)).union(rest)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of scanned documents."""
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["at"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), lambda s: F.concat_ws(":", s["kind"], s["at"], s["end"]))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(listed, ",").alias("spans"))
