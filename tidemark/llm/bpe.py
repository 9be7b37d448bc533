"""BPE encoding and decoding by speculation and verification.

Words that the cache doesn't hold are first cut greedily into the longest tokens. That guess is the merge
result exactly if no merge would cross any boundary between two neighbours, which depends on the two tokens
alone. All distinct neighbour pairs of a batch are checked together in numpy, by undoing the merges of both
tokens from the last one on. Only words with a failing pair are merged exactly, rank by rank.

The vocabulary file is read on each executor from ``vocab_path``, a local file of the tokenizer package that
is installed on every node; it is never copied.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import held, release, small_batches, widened

CACHE_WORDS = 150_000
SLICE_ROWS = 64

_PLAIN, _ENDING = 0, 1  # keys of a trie node besides its characters
_NEVER = np.int64(1) << np.int64(40)


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_texts(spec: dict) -> np.ndarray:
    """The text of each token by its id, which is all that decoding takes."""
    known = {**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec["added_tokens"]}}
    out = np.full(max(known.values()) + 1, "", object)
    for text, i in known.items():
        out[i] = text
    return out


class Bpe:
    """A byte-level vocabulary with word ends, and its encoder for single words."""

    def __init__(self, path: str):
        spec = _read(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.texts = token_texts(spec)
        size = len(self.texts)
        self.byte = _byte_characters()
        self.vocab = vocab
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        pairs = sorted((a * size + b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.size = size
        self.pair_key, self.pair_rank, self.pair_result = np.array(pairs, np.int64).T.copy()
        self._split_tokens()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.ascii_pattern = re.compile(re.sub(r"\[?\\p\{L\}\]?(?=\+)", "[a-z]", pattern).replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers

    def _symbols(self, word: str) -> list[int]:
        chars = [self.byte[b] for b in word.encode()]
        chars[-1] += self.end
        return [self.vocab[c] for c in chars]

    def _merge(self, ids: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Apply the merges to symbols in the order of rank, leftmost first; also the merges made (rank, left, right)."""
        n = len(ids)
        after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        ids, made = list(ids), []
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            made.append((rank, a, b))
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0], made

    def _split_tokens(self) -> None:
        """The last merge of every token that its own text encodes to; other tokens are never guessed."""
        self.made = np.full(self.size, -1, np.int64)  # rank of a token's last merge; -1: a single symbol
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.trie: dict = {}
        for text, i in self.vocab.items():
            body = text.removesuffix(self.end) if len(text) > len(self.end) else text
            symbols = list(body)
            if body != text:
                symbols[-1] += self.end
            if any(s not in self.vocab for s in symbols):
                continue
            ids, made = self._merge([self.vocab[s] for s in symbols])
            if ids == [i]:
                if made:
                    self.made[i], self.left[i], self.right[i] = made[-1]
                node = self.trie
                for ch in body:
                    node = node.setdefault(ch, {})
                node[_PLAIN if body == text else _ENDING] = i

    def _guess(self, word: str) -> list[int]:
        """Greedy longest match along the token trie; a token with the word's end counts only there."""
        text = "".join([self.byte[b] for b in word.encode()])
        out, at, n = [], 0, len(text)
        while at < n:
            node, i, found, stop = self.trie, at, -1, at + 1
            while i < n and (node := node.get(text[i])) is not None:
                i += 1
                if i < n and _PLAIN in node:
                    found, stop = node[_PLAIN], i
            if node is not None and i == n and _ENDING in node:
                out.append(node[_ENDING])
                break
            out.append(found)
            at = stop
        return out

    def _merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of many words: in each step every word makes its lowest-ranked merge, the leftmost of equals."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lo = 0
        while lo < len(order):
            shortest = lengths[order[lo]]
            hi = int(np.searchsorted(lengths[order], shortest + max(3, shortest // 4), "right"))
            hi = min(hi, lo + max(1, (1 << 17) // int(lengths[order[hi - 1]])))
            self._merge_block(order[lo:hi], words, out)
            lo = hi
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_result[at]

    def _merge_block(self, rows: np.ndarray, words: list[list[int]], out: list[list[int]]) -> None:
        width = max(len(words[r]) for r in rows)
        if width > 400:  # a few very long words: heap merging, linear in memory
            for r in rows:
                out[r] = self._merge(words[r])[0]
            return
        ids = np.full((len(rows), width + 1), -1, np.int64)  # one column of padding at least
        for k, r in enumerate(rows):
            ids[k, : len(words[r])] = words[r]
        rank, result = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            going = rank[line, at] < _NEVER
            for k in np.flatnonzero(~going):
                row = ids[k]
                out[rows[k]] = row[row >= 0].tolist()
            rows, ids, rank, result, at = rows[going], ids[going], rank[going], result[going], at[going]
            if not len(rows):
                return
            line, w = np.arange(len(rows)), ids.shape[1]
            ids[line, at] = result[line, at]
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = np.column_stack([ids[keep].reshape(-1, w - 1), np.full(len(rows), -1)])
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = np.column_stack([rank[keep].reshape(-1, w - 2), np.full(len(rows), _NEVER)])
            result = np.column_stack([result[keep].reshape(-1, w - 2), np.zeros(len(rows), np.int64)])
            rank[line, at], result[line, at] = self._ranks(ids[line, at], ids[line, at + 1])
            inner = line[at > 0]
            rank[inner, at[inner] - 1], result[inner, at[inner] - 1] = self._ranks(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b stay apart when their texts are encoded side by side.

        The later of the two last merges is undone step by step. A merge across the boundary would have come
        first if its rank is below that of the merge last undone on the left, or not above it on the right
        (of equal merges the leftmost is made first).
        """
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)
            crossed = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < _NEVER)
            ok[live[crossed]] = False
            rx, ry = self.made[x], self.made[y]
            go_left = rx >= ry
            left, right = live[go_left], live[~go_left]
            until_a[left], a[left] = rx[go_left], self.right[x[go_left]]
            until_b[right], b[right] = ry[~go_left], self.left[y[~go_left]]
            live = live[~crossed & ((rx >= 0) | (ry >= 0))]
        return ok

    def learn(self, missing: list[str]) -> None:
        """Put the ids of words into the cache."""
        guesses = [self._guess(w) for w in missing]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self._stable(pairs // self.size, pairs % self.size)[where] if len(pairs) else np.zeros(0, bool)
        failing = np.unique(owner[inner[~ok]]).tolist()
        for k, ids in zip(failing, self._merge_all([self._symbols(missing[k]) for k in failing])):
            guesses[k] = ids
        for word, ids in zip(missing, guesses):
            self.cache[word] = np.array(ids, np.int32).tobytes()

    def pieces(self, text: str) -> list[str]:
        """The words of a text: normal form, white space as one blank, lower case, then the pattern's matches."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            return self.pattern.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())
        return self.ascii_pattern.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for text in texts:
            parts = self.special_pattern.split(text) if "<|" in text else [text]
            split.append([(p, None) if p in self.special else (None, self.pieces(p)) for p in parts])
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        missing = set().union(*(ws for parts in split for _, ws in parts if ws)).difference(self.cache)
        if missing:
            self.learn(list(missing))
        get = self.cache.__getitem__
        out = []
        for parts in split:
            ids = [b"".join(map(get, ws)) if special is None else np.int32(self.special[special]).tobytes() for special, ws in parts]
            out.append(np.frombuffer(b"".join(ids), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.texts[ids].tolist())


def model(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


def _rows(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for lo in range(0, len(column), SLICE_ROWS):
        yield lo, pc.fill_null(column.slice(lo, SLICE_ROWS), "").to_pylist()


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in rows], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *(x for x in rows if x is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in rows], pa.bool_()))


def _coded(path: str, at: int, kept: list[int], decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for lo, texts in _rows(batch.column(at)):
                own, ids = batch.slice(lo, SLICE_ROWS), bpe.encode(texts)
                added = {"ids": _lists(ids)} | ({"decoded": pa.array(map(bpe.decode, ids), pa.string())} if decoded else {})
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), *added.values()], [*(own.schema.names[k] for k in kept), *added])
            release()

    return run


def _decode(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for lo in range(0, len(batch), SLICE_ROWS):
                own = batch.slice(lo, SLICE_ROWS)
                texts = [bpe.decode(v.values.to_numpy()) if v.is_valid else None for v in own.column(at)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], [*own.schema.names, "decoded"])

    return run


def _encoded(df: DataFrame, vocab_path: str, text: str, columns: list[str] | None, **added: str) -> DataFrame:
    small_batches(df.sparkSession)  # the codes of a batch are as large as its texts, on both sides
    df = df.drop(*(c for c in added if c != text))
    columns = [c for c in (df.columns if columns is None else columns) if c not in added]
    fn = _coded(vocab_path, df.columns.index(text), [df.columns.index(c) for c in columns], "decoded" in added)
    return df.mapInArrow(fn, widened(df.select(columns), **added))


def encode(df: DataFrame, vocab_path: str, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) with ``ids``: the token ids of the whole text; null and empty texts have none.

    An existing column ``ids`` is replaced. Special tokens in a text get their own ids; every row is coded on its own.
    """
    return _encoded(df, vocab_path, text, columns, ids="array<int>")


def round_trip(df: DataFrame, vocab_path: str, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` of ``df`` with ``ids`` and what they decode to, ``decoded``, in one pass; columns of these names are replaced."""
    return _encoded(df, vocab_path, text, columns, ids="array<int>", decoded="string")


def decode(df: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the token texts joined by one blank; null for null ids."""
    df = df.drop("decoded")
    return df.mapInArrow(_decode(vocab_path, df.columns.index(ids)), widened(df, decoded="string"))


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
