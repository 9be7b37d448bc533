"""Words of a script without blanks, by a lexicon of word frequencies.

A run of Han characters is a lattice: an edge for every word of the lexicon that occurs in it and for each single
character. The best path has the largest product of word probabilities. Batches of runs are worked on as one array of code
points: a trie is followed from all places at once for as long as a word goes on there, runs are cut where no word crosses (which
no path is the worse for), and the pieces' best paths grow from their ends, all pieces at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import Segmenter

#: Words of a lexicon that tasks get, the most frequent ones, and characters of a word at most.
MAX_WORDS, MAX_LENGTH = 1_000_000, 12
#: Pieces' ends grow together as long as so many places are at one distance from them; the few long pieces that are left go place by place.
_FEW = 48

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` code points from each place on."""
    out = np.full(max(0, len(codes) - length + 1), length, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _BASE + _mix(codes[k : k + len(out)])
    return _mix(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def is_han(codes: np.ndarray) -> np.ndarray:
    # Blocks of Han characters.
    blocks = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
    return np.logical_or.reduce([(codes >= lo) & (codes <= hi) for lo, hi in blocks])


class Lexicon:
    """Logarithms of word probabilities at the nodes of a trie; a character that is no word counts as seen once."""

    def __init__(self, words: dict[str, int]):
        words = {w: n for w, n in words.items() if w and 0 < len(w) <= MAX_LENGTH and n > 0}
        self.log_total = float(np.log(max(1, sum(words.values()))))
        codes, sizes = _codes("".join(words)), np.array([len(w) for w in words], np.int64)
        letters = np.unique(codes)
        self.letter = np.full(0x110000, len(letters), np.int32)  # of each code point; the last one stands for all others
        self.letter[letters] = np.arange(len(letters))
        self.n_letters = len(letters) + 1
        # node 0 is the root; a node is known by its parent and its letter
        begin, node = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        keys, n = [np.array([-1])], 1
        for k in range(int(sizes.max(initial=0))):
            deep = np.flatnonzero(sizes > k)
            own, node[deep] = np.unique(node[deep] * self.n_letters + self.letter[codes[begin[deep] + k]], return_inverse=True)
            node[deep] += n
            keys.append(own)
            n += len(own)
        self.key = np.concatenate(keys)
        self.log = np.full(n, -np.inf)
        self.log[node] = np.log(np.array(list(words.values()), float)) - self.log_total
        # nodes by hash of their key: the first free slot from there on; half of the slots at least stay empty (node 0)
        self.shift = 64 - max(4, (2 * n).bit_length())
        self.slots = np.zeros(1 << (64 - self.shift), np.int32)
        left, at = np.arange(1, n), self._slot(self.key[1:])
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & (len(self.slots) - 1)
        self.root = self._next(np.zeros(self.n_letters, np.int64), np.arange(self.n_letters))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node behind each node by a letter; 0 if there is none."""
        key = node * self.n_letters + letter
        at = self._slot(key)
        found = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((found != 0) & (self.key[found] != key))
        while len(open_):  # another node's slot: the next one
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found[open_] = now = self.slots[at[open_]]
            open_ = open_[(now != 0) & (self.key[now] != key[open_])]
        return found

    def edges(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, log of the probability, number of shorter ones of the place) of all words in runs that begin where ``first`` is true, each single character among them."""
        n = len(codes)
        letter = self.letter[codes]
        left = np.append(np.flatnonzero(first)[1:], n)[np.cumsum(first) - 1] - np.arange(n)  # characters to the run's end
        node = self.root[letter]
        single = self.log[node]
        out = [(np.arange(n), np.ones(n, np.int64), np.where(np.isneginf(single), -self.log_total, single), np.zeros(n, np.int64))]
        at, length, shorter = np.flatnonzero(node), 1, np.ones(n, np.int64)
        node = node[at]
        while len(at):
            inside = np.flatnonzero(left[at] > length)
            at, node = at[inside], node[inside]
            node = self._next(node, letter[at + length])
            there = np.flatnonzero(node)
            at, node, length = at[there], node[there], length + 1
            log = self.log[node]
            word = np.flatnonzero(log > -np.inf)
            own = at[word]
            out.append((own, np.full(len(own), length), log[word], shorter[own]))
            shorter[own] += 1
        return tuple(np.concatenate(x) for x in zip(*out))

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a word of the best path starts at each place of ``codes``, whose runs begin where ``first`` is true.

        Of paths of one weight the one with the longer first word wins.
        """
        n = len(codes)
        if not n:
            return np.zeros(0, bool)
        place, length, log, shorter = self.edges(codes, first)
        # +1 behind a word's start, -1 at its end: places within a word
        crossed = np.bincount(place + 1, minlength=n + 1) - np.bincount(place + length, minlength=n + 1)
        cut = first | (np.cumsum(crossed[:n]) == 0)  # pieces that no word crosses into
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, n))
        # best[p]: the weight of the best path from p to its piece's end; places at one distance from their end go together
        to_end = np.repeat(begin + size, size) - np.arange(n)
        order = np.argsort(to_end.astype(np.uint16) if int(size.max()) < 1 << 16 else to_end, kind="stable")
        words = np.bincount(place, minlength=n)[order]
        own = np.cumsum(words) - words  # where a place's words begin
        begins = np.empty(n, np.int64)
        begins[order] = own
        to = begins[place] + shorter
        follow = np.where(length < to_end[place], place + length, n)  # behind a word that ends its piece nothing follows
        sorted_ = [np.empty_like(x) for x in (place, length, log, follow)]
        for x, y in zip(sorted_, (place, length, log, follow)):
            x[to] = y
        place, length, log, follow = sorted_
        count = np.bincount(to_end)[1:]
        bounds = np.append(0, np.cumsum(count))
        few = np.flatnonzero(count < _FEW)
        together = int(few[0]) if len(few) else len(count)
        best, step = np.zeros(n + 1), np.ones(n, np.int64)
        for d in range(together):
            at, each, here = own[bounds[d] : bounds[d + 1]], words[bounds[d] : bounds[d + 1]], order[bounds[d] : bounds[d + 1]]
            lo, hi = at[0], at[-1] + each[-1]
            w, groups = log[lo:hi] + best[follow[lo:hi]], at - lo
            best[here] = top = np.maximum.reduceat(w, groups)
            step[here] = np.maximum.reduceat(np.where(w == np.repeat(top, each), length[lo:hi], 0), groups)
        if together < len(count):
            self._one_by_one(*(x[own[bounds[together]] :] for x in (place, length, log, follow)), best, step)
        out = np.zeros(n, bool)
        at, end = begin, begin + size
        while len(at) >= _FEW:  # a word of every piece at a time
            out[at] = True
            at = at + step[at]
            left = at < end
            at, end = at[left], end[left]
        for p, e in zip(at.tolist(), end.tolist()):
            steps, k, found = step[p:e].tolist(), 0, []
            while k < len(steps):
                found.append(p + k)
                k += steps[k]
            out[found] = True
        return out

    @staticmethod
    def _one_by_one(place, length, log, follow, best: np.ndarray, step: np.ndarray) -> None:
        """The rest of ``best`` and ``step`` by words in order of their places' distances."""
        known = dict.fromkeys(place.tolist(), -np.inf)
        steps = dict.fromkeys(known, 1)
        before = best[follow].tolist()
        for p, size, w, f, b in zip(place.tolist(), length.tolist(), log.tolist(), follow.tolist(), before):
            w += known.get(f, b)
            if w >= known[p]:
                known[p], steps[p] = w, size
        best[list(known)] = list(known.values())
        step[list(steps)] = list(steps.values())

    def spaced(self, texts: list[str]) -> list[str]:
        """The texts with a blank before each word of a Han run, and after the run."""
        sizes = np.array([len(t) for t in texts])
        codes = _codes("".join(texts)).astype(np.uint32)
        han = is_han(codes)
        begins = np.zeros(len(codes) + 1, bool)
        begins[np.append(0, np.cumsum(sizes))] = True
        begins = begins[: len(codes)]
        where = np.flatnonzero(han)
        first = begins[where] | np.append(True, np.diff(where) > 1)[: len(where)]
        word = np.zeros(len(codes), bool)
        word[where] = self.starts(codes[where], first)
        after = ~han & np.append(False, han[:-1])[: len(codes)] & ~begins
        blank = word | after
        out = np.full(len(codes) + int(blank.sum()), 0x20, np.uint32)
        places = np.arange(len(codes)) + np.cumsum(blank)
        out[places] = codes
        ends = np.append(0, np.cumsum(sizes))
        shift = np.append(0, np.cumsum(blank))
        return [out[ends[k] + shift[ends[k]] : ends[k + 1] + shift[ends[k + 1]]].tobytes().decode("utf-32-le", "surrogatepass").strip() for k in range(len(texts))]


#: Characters that are segmented together.
_TOGETHER = 1 << 18


def segmenter(lexicon: DataFrame) -> Segmenter:
    """A segmenter for ``tokens`` and ``bm25.retrieve`` from a lexicon (word, freq).

    Words are lower-cased, equal ones summed; those with a null, without a positive frequency or of more than
    MAX_LENGTH characters are no words. The MAX_WORDS most frequent ones go, a trie with a node for each different beginning, to the tasks. With an
    empty lexicon each character is a word. Null texts stay null; other scripts stay as they are.
    """
    words = lexicon.where(f"word is not null and freq > 0 and length(word) between 1 and {MAX_LENGTH}").groupBy(F.lower("word").alias("word")).agg(F.sum("freq").cast("long").alias("freq"))
    top = words.orderBy(F.desc("freq"), "word").limit(MAX_WORDS).collect()
    shared = lexicon.sparkSession.sparkContext.broadcast(Lexicon({r["word"]: r["freq"] for r in top}))

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            filled, out, held, size = texts.fillna("").tolist(), [], [], 0
            for t in filled:
                held.append(t)
                size += len(t)
                if size >= _TOGETHER:
                    out += own.spaced(held)
                    held, size = [], 0
            out += own.spaced(held) if held else []
            yield pd.Series(out, index=texts.index).where(texts.notna(), None)

    return lambda text: cut(text)


def learn(texts: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """(word, freq): runs of up to ``longest`` Han characters that ``texts`` repeat and hold together.

    A run of two and more is a word if it occurs ``least`` times, and at every cut so many times as often as its two
    sides would meet by chance. Single characters are words with their counts. All texts count, runs are counted before
    they are shuffled; no lexicon is needed beforehand.
    """
    runs = texts.select(F.explode(F.expr(f"regexp_extract_all(lower({text}), '([\\\\p{{IsHan}}]+)', 1)")).alias("run"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda k: F.substring(F.col("run"), k, n))).otherwise(F.array().cast("array<string>"))))
    counts = runs.select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    total = counts.where("length(word) = 1").agg(F.sum("freq").alias("total"))
    own = counts.where(f"length(word) > 1 and freq >= {least}")
    cuts = own.select("word", "freq", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("at"))
    cuts = cuts.select("word", "freq", F.expr("substring(word, 1, at)").alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    sides = counts.where(f"freq >= {least}")  # the sides of a run occur as often as it does
    cuts = cuts.join(sides.select(F.col("word").alias("left"), F.col("freq").alias("n_left")), "left").join(sides.select(F.col("word").alias("right"), F.col("freq").alias("n_right")), "right")
    held = cuts.join(F.broadcast(total)).groupBy("word", "freq").agg(F.min(F.col("freq") * F.col("total") / (F.col("n_left") * F.col("n_right"))).alias("together"))
    return held.where(F.col("together") >= cohesion).select("word", "freq").unionByName(counts.where("length(word) = 1"))
