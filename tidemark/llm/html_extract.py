"""Main-text extraction with a recurrent block labeller.

A page is cut into its leaf blocks in order, each with the path of tags, classes and ids above it. A block's
vector has hashed path tokens, hashed words and a few measures; a bidirectional LSTM in numpy reads a page's
vectors and labels every block with the whole page in view.

The labeller is trained here on a bounded sample of the pages. Their semantic tags give the labels; each page
is also shown with its tags and classes swapped for others and with notices, comments, menus and forms put in,
so that the network learns more than the one tag that gave the label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import hash_bound, held, widened
from ._words import text_slices, word_hashes, words

#: Different pages to learn from, and the characters of html from the start of each; all blocks of every page are labelled.
MAX_PAGES, MAX_PAGE_CHARS = 192, 65_536
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 256, 64, 8, 16
EPOCHS, BATCH, RATE = 6, 16, 0.01
MAX_VARIANTS, LEAST_SHOWN, LEAST_STEPS = 32, 320, 200
#: Blocks of the pages that are labelled together.
BATCH_BLOCKS = 4096

# Elements whose content is never text of a page, void elements, and elements inside a block.
HIDDEN_TAGS = "script style template noscript svg iframe object select option button textarea head title".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
# Path tokens that mark the frame of a page, and those that mark its article.
FRAME = set("nav menu header footer aside sidebar ad advert advertisement banner promo sponsor cookie consent notice alert form comment respons reply share social related newsletter subscribe breadcrumb pagination copyright widget popup modal login search toolbar".split())
ARTICLE = set("article main content post entry story body-text articlebody".split())

# Hidden elements that may lack an end tag, by what ends the search for it, and elements of a head.
_LOOSE = {t: re.compile(rf"</{t}\s*>{more}", re.I) for t, more in {"svg": "", "object": "", "button": r"|<button\b", "option": r"|<(?:option|optgroup)\b|</(?:select|datalist|optgroup)\b"}.items()}
_LABEL = re.compile(r"[^<]*(?=<(?:/?option|/?optgroup|/select|/datalist)\b)", re.I)
_IN_HEAD = set("html head base basefont bgsound link meta title script style template noscript".split())

_RAW = "|".join(t for t in HIDDEN_TAGS if t != "head" and t not in _LOOSE)
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>"']|"[^"]*"|'[^']*'|["'])*?(?:>|\Z)(?:.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.I | re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Path:
    """The tags, classes and ids above a block, outermost first, as a link to the path above and the tokens of one element.

    What the labeller needs of a path is kept with it, so that a deep page costs no more than its elements.
    """

    __slots__ = ("up", "own", "places", "length")

    def __init__(self, up: Path | None, own: tuple[str, ...]):
        self.up, self.own = up, own
        self.places, self.length = (up.places, up.length + len(own)) if up else (0, len(own))
        for token in own:
            self.places |= 1 << _place(token)

    @property
    def last(self) -> str:
        return self.own[-1]

    def inner_first(self) -> Iterator[str]:
        at: Path | None = self
        while at:
            yield from reversed(at.own)
            at = at.up


def _place(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_DIMS


def _tokens(tag: str, rest: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in rest:
        for m in _MARK.finditer(rest):
            for part in _PART.findall(m[1] or m[2] or m[3] or ""):
                part = part.lower()
                out.append("." + (part[:-1] if len(part) > 3 and part.endswith("s") else part))
    return tuple(out)


def _hidden_end(html: str, tag: str, rest: str, at: int, gone: set[str]) -> int:
    """Where a hidden element that may lack an end tag ends, if its start tag ends at ``at``.

    That is at its end tag, or else at ``at``; an option without one ends with its label. ``gone`` has the
    tags whose search has reached the end of the page.
    """
    if tag in gone or (tag == "svg" and rest.endswith("/")):
        return at
    m = _LOOSE[tag].search(html, at)
    if m is None:
        gone.add(tag)
        return at
    if m[0].lower().startswith(f"</{tag}") and m[0].endswith(">"):
        return m.end()
    label = _LABEL.match(html, at) if tag == "option" else None
    return label.end() if label else at


def blocks(html: str) -> list[tuple[Path | None, str, int]]:
    """(path, text, characters in links) of the leaf blocks of a page, in order; the path is None outside of any element.

    Character references are decoded, white space becomes one blank; blocks without text are left out. Tags
    that are never closed, or closed without being open, are taken as browsers mostly take them; a head ends
    at the first text or element that can't be in one.
    """
    out: list[tuple[Path | None, str, int]] = []
    stack: list[tuple[str, Path | None]] = []
    opened: Counter[str] = Counter()  # elements of the stack by tag
    parts: list[str] = []
    linked, in_head, at = 0, False, 0

    def pop() -> str:
        tag, _ = stack.pop()
        opened[tag] -= 1
        return tag

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    gone: set[str] = set()
    while m := _TOKEN.search(html, at):
        if in_head and html[at : m.start()].strip():
            in_head = False
        if m.start() > at and not in_head:
            piece = html[at : m.start()]
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in _IN_HEAD:
                in_head = False
            continue
        tag = tag.lower()
        if tag == "head":
            in_head = not m["end"]
            continue
        if not m["end"] and tag not in _IN_HEAD:
            in_head = False
        if tag in _LOOSE:
            if not m["end"]:
                at = _hidden_end(html, tag, m["rest"], at, gone)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag not in INLINE:
            close()
        if m["end"]:
            while opened[tag] and pop() != tag:
                pass
            continue
        if tag not in INLINE:  # a new block ends open inline tags; p, li and cells end their like
            while stack and (stack[-1][0] in INLINE or (stack[-1][0] == tag and tag in {"p", "li", "td", "th", "tr", "dt", "dd", "option"}) or (stack[-1][0] == "p" and tag != "p")):
                pop()
        if not m["rest"].endswith("/"):
            above = stack[-1][1] if stack else None
            stack.append((tag, above if tag in INLINE and tag != "a" else Path(above, _tokens(tag, m["rest"]))))
            opened[tag] += 1
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


def vectors(page: list[tuple[Path | None, str, int]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The input of the network for the blocks of one page, or those from ``lo`` to ``hi`` of them."""
    own, total = page[lo:hi], len(page)
    n = len(own)
    out = np.zeros((n, PATH_DIMS + WORD_DIMS + MEASURES), np.float32)
    if not n:
        return out
    marks = [(path.places | 1 << _place("leaf " + path.last) if path else 0).to_bytes(PATH_DIMS // 8, "little") for path, _, _ in own]
    out[:, :PATH_DIMS] = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(n, -1), axis=1, bitorder="little")
    for first, last, data, offsets in text_slices(pa.array([t for _, t, _ in own], pa.large_string())):
        starts, ends, at = words(data, offsets)
        rows = np.repeat(np.arange(last - first), np.diff(at))
        places = (word_hashes(data, starts, ends, lower=True) >> np.uint64(58)).astype(np.int64)
        counts = np.bincount(rows * WORD_DIMS + places, minlength=(last - first) * WORD_DIMS).reshape(last - first, WORD_DIMS)
        out[first:last, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1)
    n_words = np.array([t.count(" ") + 1 for _, t, _ in own])  # a block's white space is single blanks
    size = np.array([len(t) for _, t, _ in own], float)
    stops = np.array([sum(t.count(c) for c in ".,;!?") for _, t, _ in own], float)
    most = max(t.count(" ") + 1 for _, t, _ in page)
    out[:, -MEASURES:] = np.column_stack([np.log1p(size) / 8, np.log1p(n_words) / 6, np.array([x for _, _, x in own]) / size, stops / n_words, np.array([t[-1:] in ".!?\"'" for _, t, _ in own]), (np.arange(lo, lo + n) + 0.5) / total, n_words / most, np.array([p.length if p else 0 for p, _, _ in own]) / 10])
    return out


class Network:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        d, h, rng = PATH_DIMS + WORD_DIMS + MEASURES, HIDDEN, np.random.default_rng(seed)
        self.w = weights or {
            **{f"x{s}": rng.normal(0, 0.08, (d, 4 * h)) for s in "fb"},
            **{f"h{s}": rng.normal(0, 0.15, (h, 4 * h)) for s in "fb"},
            **{f"b{s}": np.repeat([0.0, 1.0, 0.0, 0.0], h) for s in "fb"},
            "out": rng.normal(0, 0.2, 2 * h),
            "bias": np.zeros(1),
        }

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Hidden states (T, B, H) from ``state`` on, and the last state; ``keep`` gets what the backward pass needs."""
        w, h = self.w, HIDDEN
        t, b, d = x.shape
        into = (x.reshape(t * b, d) @ w[f"x{side}"]).reshape(t, b, 4 * h) + w[f"b{side}"]
        out = np.zeros((t, b, h))
        hid, cell = state or (np.zeros((b, h)), np.zeros((b, h)))
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            gates = into[k] + hid @ w[f"h{side}"]
            sig = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * h], -30, 30)))
            i, f, o, g = sig[:, :h], sig[:, h : 2 * h], sig[:, 2 * h :], np.tanh(gates[:, 3 * h :])
            m = mask[k][:, None]
            before = (hid, cell)
            cell = m * (f * cell + i * g)
            th = np.tanh(cell)
            hid = m * o * th
            out[k] = hid
            if keep is not None:
                keep.append((k, i, f, o, g, th, *before, m))
        return out, (hid, cell)

    def _chances(self, both: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["bias"], -30, 30)))

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._chances(np.concatenate([self._pass(x, mask, s)[0] for s in "fb"], axis=2))

    def long_page(self, page: list, step: int = BATCH_BLOCKS) -> np.ndarray:
        """The probabilities of one page of any length: both directions go through it part by part, handing on their state.

        Beside the blocks themselves only the hidden states are held, 128 bytes a block.
        """
        n, states = len(page), {}
        for side in "fb":
            states[side], state = np.zeros((n, HIDDEN), np.float32), None
            parts = range(0, n, step)
            for lo in parts if side == "f" else reversed(parts):
                x = vectors(page, lo, lo + step)[:, None, :]
                out, state = self._pass(x, np.ones((len(x), 1)), side, None, state)
                states[side][lo : lo + step] = out[:, 0]
        return self._chances(np.concatenate([states["f"], states["b"]], axis=1))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.w, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._pass(x, mask, s, kept[s])[0] for s in "fb"], axis=2)
        p = self._chances(both)
        d_out = (p - y) * mask / mask.sum()
        grad = {"out": np.einsum("tb,tbh->h", d_out, both), "bias": d_out.sum(keepdims=True).reshape(1)}
        d_both = d_out[:, :, None] * w["out"]
        for s, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            d_gates = np.zeros((*x.shape[:2], 4 * h))
            grad[f"h{s}"] = np.zeros((h, 4 * h))
            d_hid, d_cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for k, i, f, o, g, th, hid0, cell0, m in reversed(kept[s]):
                dh = (part[k] + d_hid) * m
                dc = (d_cell + dh * o * (1 - th**2)) * m
                own = np.concatenate([dc * g * i * (1 - i), dc * cell0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                d_gates[k] = own
                grad[f"h{s}"] += hid0.T @ own
                d_hid, d_cell = own @ w[f"h{s}"].T, dc * f
            flat = d_gates.reshape(-1, 4 * h)
            grad[f"x{s}"], grad[f"b{s}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam over batches of pages of about one length, for ``epochs`` and LEAST_STEPS at least."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for _ in range(max(epochs, -(-LEAST_STEPS // len(batches)))):
            for b in rng.permutation(len(batches)):
                x, mask = padded([pages[k][0] for k in batches[b]])
                y = np.zeros(mask.shape)
                for j, k in enumerate(batches[b]):
                    y[: len(pages[k][1]), j] = pages[k][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """The probability that each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order) and len(pages[order[lo]]) <= BATCH_BLOCKS:
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= BATCH_BLOCKS:
                hi += 1
            own = order[lo:hi]
            x, mask = padded([vectors(pages[k]) for k in own])
            p = self.probabilities(x, mask)
            for j, k in enumerate(own):
                out[k] = p[: len(pages[k]), j]
            lo = hi
        for k in order[lo:]:
            out[k] = self.long_page(pages[k])
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages)))
    for j, own in enumerate(pages):
        x[: len(own), j], mask[: len(own), j] = own, 1.0
    return x, mask


def teacher(path: Path | None) -> int | None:
    """1 for a block under an article mark, 0 under a frame mark (the inner one counts), None for neither."""
    for token in path.inner_first() if path else ():
        if token.lstrip(".") in FRAME:
            return 0
        if token.lstrip(".") in ARTICLE:
            return 1
    return None


# Other paths under which the same kinds of blocks are shown in training.
_ARTICLE_PATHS = (("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry"), ("div", ".story"), ("article", ".post"), ("div",))
_FRAME_PATHS = {
    "menu": (("nav", "ul", "li", "a"), ("div", ".menu", "ul", "li", "a"), ("header", "nav", "a"), ("ul", ".nav", "li", "a"), ("div", ".breadcrumb", "a"), ("aside", ".sidebar", "ul", "li", "a"), ("div", ".related", "ul", "li", "a")),
    "line": (("footer",), ("div", ".footer", "p"), ("footer", "p"), ("header", "div"), ("header", "p"), ("div", ".copyright"), ("div", ".header")),
    "note": (("div", ".ad"), ("div", ".cookie", ".notice", "p"), ("div", ".banner"), ("aside", ".promo", "p"), ("aside", "p"), ("div", ".sidebar", "p"), ("div", ".newsletter", "p"), ("form", "p"), ("form", "label"), ("div", ".alert"), ("div", ".advert", "p"), ("div", ".notice"), ("div", ".sponsor", "p")),
    "comment": (("section", ".comment", "div", ".comment", "p"), ("div", ".comment", "p"), ("div", ".respons", "li", "p"), ("ol", ".comment", "li", "p"), ("div", ".comment", "article", "p")),
}


def _shown_otherwise(page: list, labels: list[int], others: list[str], rng: np.random.Generator) -> tuple[list, list[int]]:
    """The page with other paths around its blocks and other blocks put in."""
    pick = lambda options: options[rng.integers(len(options))]
    article = pick(_ARTICLE_PATHS)
    kinds = {k: pick(v) for k, v in _FRAME_PATHS.items()}
    top = ("html", "body") + ("div", ".page") * int(rng.integers(2))
    main, before, after = [], [], []
    for (path, text, linked), y in zip(page, labels):
        if y:
            main.append((Path(None, (*top, *article, path.last if path and path.last[0] != "." else "p")), text, linked))
        else:
            kind = "menu" if linked * 2 > len(text) else "line" if path and path.last == "footer" else "note"
            (before if not main else after).append((Path(None, (*top, *kinds[kind])), text, linked))
    words_of = lambda n: " ".join(pick(others).split()[:n]) or "-"
    for _ in range(int(rng.integers(0, 3))):
        kind = pick(("menu", "line", "note"))
        text = words_of(int(rng.integers(1, 4 if kind == "menu" else 25)))
        pick((before, after)).append((Path(None, (*top, *pick(_FRAME_PATHS[kind]))), text, len(text) if kind == "menu" else 0))
    if rng.random() < 0.5:
        for _ in range(int(rng.integers(1, 6))):
            after.append((Path(None, (*top, *kinds["comment"])), words_of(int(rng.integers(3, 80))), 0))
    inner = []
    if rng.random() < 0.3 and len(main) > 2:  # an advert or a notice within the article
        inner = [(len(before) + int(rng.integers(1, len(main))), (Path(None, (*top, *article, *pick(_FRAME_PATHS["note"]))), words_of(int(rng.integers(2, 20))), 0))]
    out = [*before, *main, *after]
    y = [0] * len(before) + [1] * len(main) + [0] * len(after)
    for at, block in inner:
        out.insert(at, block)
        y.insert(at, 0)
    return out, y


def train_on(htmls: list[str], variants: int = 4, seed: int = 9) -> Network | None:
    """A network from the pages whose blocks the teacher can label; None if there are none.

    Few pages are shown in more variants (up to MAX_VARIANTS) and more often, so that any number is learned from.
    """
    rng = np.random.default_rng(seed)
    known = []
    for html in htmls:
        page = blocks(html)
        labelled = [(b, y) for b in page if (y := teacher(b[0])) is not None]
        if labelled and any(y for _, y in labelled):
            known.append(([b for b, _ in labelled], [y for _, y in labelled]))
    if not known:
        return None
    others = [text for page, _ in known for _, text, _ in page]
    shown = list(known)
    variants = max(variants, min(MAX_VARIANTS, LEAST_SHOWN // len(known)))
    for page, labels in known:
        shown += [_shown_otherwise(page, labels, others, rng) for _ in range(variants)]
    network = Network()
    network.train([(vectors(page), np.array(labels, float)) for page, labels in shown])
    return network


def sample(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(at, html): the first ``max_pages`` different pages in the order of a hash, each cut to its first MAX_PAGE_CHARS."""
    picked = pages.select("html").where("html <> ''").select(F.xxhash64("html").alias("at"), F.substring("html", 1, MAX_PAGE_CHARS).alias("html"))
    different = picked.select("at").distinct().count()
    return picked.where(F.col("at") <= hash_bound(2 * max_pages, different)).groupBy("at").agg(F.min("html").alias("html")).orderBy("at").limit(max_pages)


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Network | None:
    """Train on the sample of the pages, in one task."""
    picked = sample(pages, max_pages)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        network = train_on(pdf.sort_values(["at", "html"])["html"].tolist())
        weights = network.w if network else {}
        return pd.DataFrame({"name": list(weights), "shape": [list(v.shape) for v in weights.values()], "w": [v.ravel().tolist() for v in weights.values()]}, dtype=object)

    rows = picked.groupBy(F.lit(1).alias("one")).applyInPandas(run, "name string, shape array<int>, w array<double>").collect()
    return Network({r["name"]: np.array(r["w"]).reshape(r["shape"]) for r in rows}) if rows else None


def by_rule(page: list[tuple[Path | None, str, int]]) -> np.ndarray:
    """What stands for the network's probabilities where no page had a telling tag to learn from.

    A block under a mark is what the mark says; any other one is main text unless it is half links.
    """
    marks = (teacher(path) for path, _, _ in page)
    return np.array([float(2 * linked <= len(text)) if y is None else float(y) for y, (_, text, linked) in zip(marks, page)])


def _extract(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("html_extract")
        network = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                pages = [blocks(h.as_py() or "") for h in batch.column(at)]
                chances = network.label(pages) if network else [by_rule(p) for p in pages]
                texts = ["\n".join(text for (_, text, _), p in zip(page, own) if p >= 0.5) for page, own in zip(pages, chances)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def extract(pages: DataFrame, network: Network | None) -> DataFrame:
    """``pages`` with a column ``text``: the blocks labelled as main text, joined by newlines.

    A null, empty or textless html gives an empty text. Without a network (no page to learn from) blocks are labelled
    by the marks in their paths and by their links. Elements nest to any depth. An existing
    column ``text`` is replaced; other columns are kept; repeated rows get the same text. A page of more than
    BATCH_BLOCKS blocks is labelled by itself, part by part, with the whole of it in view.
    """
    pages = pages.drop("text")
    shared = pages.sparkSession.sparkContext.broadcast(network)  # some 50,000 weights, whatever the pages
    return pages.mapInArrow(_extract(shared, pages.columns.index("html")), widened(pages, text="string"))
