"""Removal of passages that an earlier document has, with repeated-phrase automata.

1. One pass gives every text the digest of its word sequence and its phrases: of every window of ``WINDOW``
   words, the sequence of ``PHRASE`` words in it with the least hash. Equal windows choose equal phrases.
2. Texts of one digest are one class, stood for by its least doc_id. In the other members every window is found
   earlier; they need no search.
3. Phrases that two representatives share recur. Each belongs to the first text that has it, and the phrases that
   stand near each other there go to one shard, so that a copied passage meets one or two shards.
4. The shards are written once, as letters of six bits of each word's hash. The hashes of a text's phrases are the
   filter before each shard: a text is streamed through the Aho-Corasick automata of all shards that have one of
   them, which find every occurrence of all phrases of the shard. A shard that very many texts meet is compiled
   by several tasks, each for its share of them.
5. The windows around an occurrence are sent out as 128-bit hashes, which confirm or reject them exactly. The
   least doc_id of every window hash is found by a partial aggregation, and what later ones cover is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import held, materialize
from ._words import mix, text_slices, word_hashes, words

WINDOW, PHRASE = 50, 16
#: Phrases in one automaton, texts that one task streams through it, and words of a text whose phrases stay together.
SHARD_PHRASES, SHARD_TEXTS, NEAR = 20_000, 4000, 1 << 16
#: Ids up to which the candidates are picked by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 500_000
#: Rows of one window in one task, and windows with more, at most.
HOT_ROWS, HOT_KEYS = 2000, 100_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EMPTY = hashlib.sha256(b"").hexdigest()


def _grams(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out, done, bits = np.zeros(len(hashes) - size + 1, np.uint64), 0, size
    step, power = hashes, base  # step: runs of the present power of two
    length = 1
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                out = out * power + step[done : done + len(out)]
                done += length
            bits >>= 1
            if bits:
                step = step[:-length] * power + step[length:]
                power, length = power * power, 2 * length
    return mix(out)


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every run of ``size`` values."""
    length = 1
    while 2 * length <= size:
        values = best(values[:-length], values[length:])
        length *= 2
    rest = size - length
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(hashes: np.ndarray, window: int = WINDOW, size: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the phrases that the windows of a text choose, and the first place of each."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = _grams(hashes, size, _BASES[0])
    width = window - size + 1
    least = _sliding(grams, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    found, first = np.unique(grams[chosen], return_index=True)
    return found, chosen[first]


def _prepare(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring_dedup")
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                starts, ends, at = words(data, offsets)
                hashes, raw = word_hashes(data, starts, ends), data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(hi - lo)]
                found = [phrases(hashes[at[i] : at[i + 1]], window, size) for i in range(hi - lo)]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32))
                listed = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([f[k] for f in found]).astype(np.int64))) for k in (0, 1)]
                listed[1] = listed[1].cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(at), pa.int64()), pa.array(digests), *listed], ["doc_id", "n_words", "digest", "phrases", "places"])

    return run


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and letters of the words of several texts, and each text's offset among them."""
    starts, ends, at = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    return hashes, ((hashes >> np.uint64(58)) + np.uint64(48)).astype(np.uint8), at


def _deal(size: int):
    """Rows of the shards: the phrases that belong to a text (rid null), and the text for each shard to stream it through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring_dedup")
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                _, letters, at = _letters(data, offsets)
                rows: list[tuple[int, int | None, bytes]] = []
                for i in range(hi - lo):
                    own = letters[at[i] : at[i + 1]].tobytes()
                    parts: dict[int, list[bytes]] = {}
                    for phrase in batch.column(2)[lo + i].as_py():
                        parts.setdefault(phrase["shard"], [])
                        if phrase["first"]:
                            parts[phrase["shard"]].append(own[phrase["place"] : phrase["place"] + size])
                    for shard, found in parts.items():
                        rows.append((shard, batch.column(0)[lo + i].as_py(), own))
                        if found:
                            rows.append((shard, None, b"".join(found)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "rid", "letters"])

    return run


def _compile(patterns: list[str], most: int) -> list[ahocorasick.Automaton]:
    out = []
    for lo in range(0, len(patterns), most):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in patterns[lo : lo + most]:
            automaton.add_word(p)
        automaton.make_automaton()
        out.append(automaton)
    return out


def _stream(size: int, most: int):
    """(rid, places of the last word) of every phrase of a shard in its texts; a shard's phrases come before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring_dedup")
        now, phrases_of, automata = None, [], None
        for batch in batches:
            rids, ends = [], []
            for shard, part, rid, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (shard, part) != now:
                    now, phrases_of, automata = (shard, part), [], None
                text = line.decode("ascii")
                if rid is None:
                    phrases_of += [text[k : k + size] for k in range(0, len(text), size)]
                    continue
                if automata is None:
                    automata = _compile(phrases_of, most)
                found = [end for automaton in automata for end, _ in automaton.iter(text)]
                rids.append(rid)
                ends.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["rid", "ends"])

    return run


def _windows(window: int, size: int):
    """128-bit hashes of the windows around the occurrences in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring_dedup")
        names = ["rid", "doc_id", "a", "b", "at"]
        for batch in batches:
            rids, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                hashes, _, at = _letters(data, offsets)
                for i in range(hi - lo):
                    own = hashes[at[i] : at[i + 1]]
                    n = max(0, len(own) - window + 1)
                    mark = np.zeros(n + 1, np.int32)
                    for ends in batch.column(3)[lo + i].values:
                        last = ends.values.to_numpy(zero_copy_only=False)
                        np.add.at(mark, np.clip(last + 1 - window, 0, n), 1)
                        np.add.at(mark, np.clip(last + 2 - size, 0, n), -1)
                    found = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    if len(found):
                        a, b = (_grams(own, window, base)[found].view(np.int64) for base in _BASES)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rids[lo + i])), pa.array(np.full(len(found), ids[lo + i])), pa.array(a), pa.array(b), pa.array(found.astype(np.int32))], names)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                own = (text.as_py() or "").encode().split()
                mark = np.zeros(len(own) + 1, np.int32)
                at = places.values.to_numpy(zero_copy_only=False)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["digest", "n_removed", "kept"])

    return run


def _later(found: DataFrame) -> DataFrame:
    """(rid, at) of the windows (rid, doc_id, a, b, at) that a smaller doc_id has too.

    A window that very many texts have is dealt out: its rows are spread over as many parts as it has times
    HOT_ROWS, and its least doc_id goes to each of them. Which windows are so is broadcast, HOT_KEYS at most.
    """
    firsts = found.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("a", "b", "least", "n")
    firsts = materialize(firsts, "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / F.lit(max(HOT_ROWS, total // HOT_KEYS))).cast("int")
    hot = F.broadcast(firsts.select("a", "b", parts.alias("parts")).where("parts > 1"))
    dealt = found.join(hot, ["a", "b"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    firsts = firsts.select("a", "b", "least", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(firsts, ["a", "b", "part"]).where("doc_id > least").select("rid", "at")


def _occurrences(texts: DataFrame, phrase: int, shard_phrases: int) -> DataFrame:
    """(rid, ends) of the texts (rid, text, phrases), where phrases (shard, place, first) tell the shards and what belongs to the text.

    A shard that more than SHARD_TEXTS texts meet has as many parts, each with all of its phrases.
    """
    dealt = texts.select("rid", "text", "phrases").mapInArrow(_deal(phrase), "shard long, rid long, letters binary")
    dealt = materialize(dealt, "shards")
    parts = dealt.groupBy("shard").agg(F.ceil(F.count("rid") / SHARD_TEXTS).cast("int").alias("parts"))
    dealt = dealt.join(parts, "shard")
    own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    part = F.explode(F.when(F.col("rid").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    rows = dealt.select("shard", part.alias("part"), "rid", "letters")
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("rid").asc_nulls_first())
    return rows.mapInArrow(_stream(phrase, shard_phrases), "rid long, ends array<int>").where("size(ends) > 0")


def dedup_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A word is removed if a window of ``window`` words covers it whose words also start, in the input, in a
    document with a smaller doc_id. ``kept`` has the words left, joined by one space, and is null where no
    word is removed (the text is then kept as it is). Null texts have no words. Rows that repeat a doc_id are
    documents of one id: none of them is earlier than the other. Rows with a null doc_id lose nothing and
    are not searched. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = docs.mapInArrow(_prepare(window, phrase), "doc_id long, n_words long, digest string, phrases array<long>, places array<int>")
    made = materialize(made.withColumn("rid", F.monotonically_increasing_id()), "phrases")
    classes = materialize(made.where(f"doc_id is not null and n_words >= {window}").groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("f")).select("digest", F.col("f.doc_id").alias("first"), F.col("f.rid").alias("rid")), "classes")
    # phrases of representatives that at least two doc_ids share
    reps = made.join(classes.select("rid"), "rid", "left_semi").select("rid", "doc_id", "phrases", "places")
    chosen = reps.select("rid", "doc_id", F.explode(F.arrays_zip("phrases", "places")).alias("p"))
    chosen = materialize(chosen.select("rid", "doc_id", F.col("p.phrases").alias("h"), F.col("p.places").alias("place")), "chosen")
    recurring = chosen.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("rid", "place")).alias("o"))
    recurring = materialize(recurring.where("least < most").select("h", F.col("o.rid").alias("owner"), F.floor(F.col("o.place") / NEAR).alias("near")), "recurring")
    shards = -(-recurring.count() // shard_phrases) or 1
    recurring = recurring.select("h", "owner", F.pmod(F.xxhash64("owner", "near"), F.lit(shards)).alias("shard"))
    places = chosen.join(recurring, "h").select("rid", "doc_id", F.struct("shard", "place", (F.col("rid") == F.col("owner")).alias("first")).alias("p"))
    places = places.groupBy("rid", "doc_id").agg(F.collect_list("p").alias("phrases"))
    places = materialize(places.join(classes.select("rid", "digest"), "rid"), "places")
    # the texts that pass the filter of a shard; the digest tells the rows that repeat a doc_id apart
    ids = places.select("doc_id").distinct()
    few = places.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    texts = texts.withColumn("digest", F.sha2(F.array_join(F.array_remove(F.split("text", r"[ \t-\r]+"), ""), " "), 256))
    texts = materialize(texts.join(places, ["doc_id", "digest"]).select("rid", "doc_id", "digest", "text", "phrases").dropDuplicates(["rid"]), "candidates")
    ends = _occurrences(texts, phrase, shard_phrases).groupBy("rid").agg(F.collect_list("ends").alias("ends"))
    found = texts.join(ends, "rid").select("rid", "doc_id", "text", "ends")
    found = materialize(found.mapInArrow(_windows(window, phrase), "rid long, doc_id long, a long, b long, at int"), "windows")
    hits = _later(found).groupBy("rid").agg(F.collect_list("at").alias("at"))
    cut = texts.select("rid", "digest", "text").join(hits, "rid").select("digest", "text", "at").mapInArrow(_cut(window), "digest string, n_removed long, kept string")
    cut = materialize(cut, "cut")
    of_class = classes.select("digest", "first").join(cut, "digest", "left")
    out = made.select("doc_id", "n_words", "digest").join(of_class, "digest", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    own = F.col("doc_id").isNotNull()
    removed = F.when(later, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long")
    kept = F.when(later, F.lit("")).when(own, F.col("kept"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce(F.sha2(kept, 256), "digest").alias("kept_sha256"), kept.alias("kept"))
