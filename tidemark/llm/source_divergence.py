"""How far the sources of a language are from each other and from the language, term by term, in whole numbers.

Texts are split in Python on concatenated UTF-8 buffers: a table of 256 bytes tells letters from the rest, xxhash
groups the slices between boundaries, and each slice is compared byte by byte with the one that stands for its group.
Counts are summed within a task and by Spark before any is shuffled alone. The kept terms of a language are dealt out into
parts of bounded size; a part is a CSR matrix of sources and terms, whose divergences are sums over its rows (reduceat),
and sums of parts are sums of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, materialize, release
from ._words import text_slices, words

SLICE = 1 << 20
#: Rows of counts that a task gathers before it hands them on.
GATHERED = 400_000
#: Entries of a part of a language's matrix, and pairs of sources that a task works out at a time.
PART_ENTRIES, BLOCK_PAIRS = 250_000, 2_000_000
ONE = 1_000_000_000
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def grouped(data: bytes, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """A number for each slice of ``data``, the same for the same bytes alone, and the bytes of each number."""
    first, last = starts.tolist(), ends.tolist()
    hashes = np.fromiter((digest(data[a:b]) for a, b in zip(first, last)), np.uint64, len(first))
    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    of = [data[first[k] : last[k]] for k in one]
    stands, lengths = one[number], ends - starts
    same = lengths == lengths[stands]
    raw = np.frombuffer(data, np.uint8)
    own = np.flatnonzero(same)
    if len(own):
        size = lengths[own]
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        differ = raw[np.repeat(starts[own], size) + within] != raw[np.repeat(starts[stands[own]], size) + within]
        same[own] = ~np.logical_or.reduceat(differ, at)
    known: dict[bytes, int] = {}
    for k in np.flatnonzero(~same):  # of one hash, but other bytes
        word = data[first[k] : last[k]]
        if word not in known:
            known[word] = len(of)
            of.append(word)
        number[k] = known[word]
    return number, of


def _counted(lang: list[str], source: list[str], data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    starts, ends, at = words(data, offsets, _LETTERS)
    term, of = grouped(_LOWER[data].tobytes(), starts, ends)
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(x, len(groups)) for x in zip(lang, source)], np.int64)
    width = max(1, len(of))
    in_row, times = np.unique(np.repeat(np.arange(len(lang)), np.diff(at)) * width + term, return_counts=True)
    key, inverse = np.unique(group[in_row // width] * width + in_row % width, return_inverse=True)
    names = list(groups)
    g, t = key // width, key % width
    of = pa.array(of, pa.binary()).cast(pa.string())
    return pa.table({
        "lang": pa.array([x for x, _ in names], pa.string()).take(pa.array(g)),
        "source": pa.array([x for _, x in names], pa.string()).take(pa.array(g)),
        "term": of.take(pa.array(t)),
        "n": np.bincount(inverse, times, len(key)).astype(np.int64),
        "docs": np.bincount(inverse, minlength=len(key)).astype(np.int64),
    })


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term"]

    def summed(held: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(held).group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*names, "n_sum", "docs_sum"]).rename_columns([*names, "n", "docs"])

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, data, offsets in text_slices(batch.column(2), SLICE):
            held.append(_counted(lang[lo:hi], source[lo:hi], data, offsets))
            rows += len(held[-1])
            if rows > GATHERED:
                held = [summed(held)]
                rows = len(held[0])
                if 2 * rows > GATHERED:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from summed(held).to_batches()
    release()


def share(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (n + 2) / (total + 2 v)), exact."""
    n, total = np.broadcast_arrays(np.asarray(n, np.int64), np.asarray(total, np.int64))
    if n.max(initial=0) < 9_000_000_000:
        return 1 + ONE * (n + 2) // (total + 2 * v)
    return np.array([1 + ONE * (x + 2) // (y + 2 * v) for x, y in zip(n.ravel().tolist(), total.ravel().tolist())], np.int64).reshape(n.shape)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


def pair_sums(p: np.ndarray, cols: np.ndarray, bounds: np.ndarray, absent: np.ndarray, n_terms: int, own: np.ndarray) -> np.ndarray:
    """The sum of divergences of the rows ``own`` from each row of a CSR matrix whose missing entries are ``absent`` of their row."""
    n = len(absent)
    out = np.zeros((len(own), n), np.int64)
    if not n_terms:
        return out
    own_absent = np.repeat(absent, np.diff(bounds))
    for i, a in enumerate(own.tolist()):
        mine = p[bounds[a] : bounds[a + 1]]
        dense = np.full(n_terms, absent[a], np.int64)
        dense[cols[bounds[a] : bounds[a + 1]]] = mine
        there = dense[cols]
        # every entry of the other row against its absence, then this row against rows without any entry
        out[i] = _row_sums(divergence(there, p) - divergence(there, own_absent), bounds)
        step = max(1, 2_000_000 // max(1, len(mine)))
        for k in range(0, n, step):
            out[i, k : k + step] += divergence(mine[None, :], absent[k : k + step, None]).sum(axis=1)
        out[i] += (n_terms - len(mine)) * divergence(absent[a], absent)
    return out


def _diverge(top: int, key: tuple, table: pa.Table) -> pa.Table:
    """(lang, source, part, item, value) of a part of a language for a block of its sources: sums over the part's terms for each pair, and the first terms of each source."""
    lang, block = key[0].as_py(), key[2].as_py()
    term = table.column("term").combine_chunks()
    totals = table.filter(term.is_null()).sort_by("source")
    sources, n_of = totals.column("source").to_pylist(), totals.column("n").to_numpy()
    entries = table.filter(term.is_valid())
    v, n_lang = totals.column("v")[0].as_py(), totals.column("of_lang")[0].as_py()
    terms = sorted({x.encode() for x in entries.column("term").unique().to_pylist()})
    place, row = {x: k for k, x in enumerate(terms)}, {x: k for k, x in enumerate(sources)}
    rows = np.array([row[x] for x in entries.column("source").to_pylist()], np.int64)
    cols = np.array([place[x.encode()] for x in entries.column("term").to_pylist()], np.int64)
    n, of_lang = entries.column("n").to_numpy(), entries.column("of_lang").to_numpy()
    order = np.lexsort((cols, rows))
    rows, cols, n, of_lang = rows[order], cols[order], n[order], of_lang[order]
    bounds = np.searchsorted(rows, np.arange(len(sources) + 1))
    p = share(n, n_of[rows], v) if v else np.zeros(0, np.int64)
    absent = share(np.zeros(len(sources)), n_of, v) if v else np.zeros(len(sources), np.int64)
    mine = np.arange(block, len(sources), totals.column("blocks")[0].as_py())
    sums = pair_sums(p, cols, bounds, absent, len(terms), mine)
    first, second = np.repeat(mine, len(sources)), np.tile(np.arange(len(sources)), len(mine))
    other = first != second
    names = pa.array(sources, pa.string())
    pairs = [names.take(pa.array(first[other])), pa.array(["pair"] * int(other.sum()), pa.string()), names.take(pa.array(second[other])), pa.array(sums.ravel()[other])]
    found = []
    q = share(of_lang, n_lang, v) if v else p
    value = divergence(p, q)
    for a in mine.tolist():
        own = np.arange(bounds[a], bounds[a + 1])
        own = own[p[own] > q[own]]
        own = own[np.lexsort((cols[own], -value[own]))[:top]]
        found += [[sources[a], "term", terms[cols[k]].decode(), int(value[k])] for k in own]
    columns = list(zip(*found)) if found else [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    both = [pa.concat_arrays([x, pa.array(c, k)]) for x, c, k in zip(pairs, columns, kinds)]
    return pa.Table.from_arrays([pa.array([lang] * len(both[0]), pa.string()), *both], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source; other columns are ignored).

    Part ``pair`` has the divergence of each source from each other source of its language, summed over the
    language's kept terms (those in ``least_docs`` of its rows); part ``term`` the ``top`` kept terms that a source has
    more of than its language. Null text, lang and source count as ''. Rows without terms count as members of their
    group; a language without kept terms has pairs of value 0. Repeated rows count each. Ties go by the item's bytes.
    An empty table gives an empty result. Values are exact: whole numbers throughout.
    """
    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = filled.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(counts.drop("docs").join(of_lang, ["lang", "term"]), "kept")
    discard(counts)
    # one row a language and one a group; a term's own rows tell how often the language has it
    sizes = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"), F.sum("entries").alias("entries"))
    groups = filled.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("entries", F.lit(0)) / F.lit(PART_ENTRIES))).cast("int")
    groups = materialize(groups, "groups")
    # a language of very many sources is also dealt out by them: each block has the whole part and some of its rows to hold against it
    blocks = F.least(F.col("n_sources"), F.ceil(F.col("n_sources") * F.col("n_sources") / F.lit(BLOCK_PAIRS))).cast("int")
    of_sources = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    sizes = materialize(of_sources.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), parts.alias("parts"), blocks.alias("blocks")), "sizes")
    entries = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("slice"), "source", "term", "n", "of_lang", "v", "blocks")
    totals = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n_lang").alias("of_lang"), "v", "blocks")
    rows = entries.unionByName(totals).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = rows.groupBy("lang", "slice", "block").applyInArrow(lambda key, part: _diverge(top, key, part), "lang string, source string, part string, item string, value long")
    found = materialize(found, "divergences")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
