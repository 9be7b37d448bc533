"""Plain Python versions of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import zstandard

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def maximal_chats(rows):
    """conv_ids that stay, of (conv_id, turn, role, text) without nulls."""
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        chats[c].append((turn, role, text))
    chats = {c: sorted(t) for c, t in chats.items()}
    return {c for c, t in chats.items() if not any(d != c and u[: len(t)] == t and (len(u) > len(t) or d < c) for d, u in chats.items())}


def near_duplicates(docs, width=2, numerator=80):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text)."""
    sets = {}
    for i, text in docs:
        w = SPACE_WORD.findall((text or "").translate(LOWER))
        sets[i] = set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)} if w else set()
    at = defaultdict(list)
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, own in sets.items():
        both = Counter(j for s in own for j in at[s])
        for j, n in both.items():
            if 100 * n >= numerator * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
        for s in own:
            at[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    of = defaultdict(set)
    for item, text in items:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            of[tuple(w[k : k + window])].add(str(item))
    sizes = {len(k) for k in of}
    out = {}
    for i, text in docs:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if known := of.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= known
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = SPACE_WORD.findall(text)
    times = Counter(zip(w, w[1:], w[2:]))
    again = {k + d for k in range(len(w) - 2) if times[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), n_dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def repeated_passages(docs, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    words = {i: SPACE_WORD.findall(text or "") for i, text in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + d for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for d in range(window)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


_SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    spans = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, ok)) in enumerate(_SECRETS.items()) for m in pattern.finditer(text or "") if ok(m)]
    n = Counter(s[2] for s in spans)
    return (n["assign"], n["access"], n["hex"], sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))


def ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """(bias, {coordinate: weight}) of FTRL-proximal, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k, first):
        if abs(z[k]) <= first:
            return 0.0
        return -(z[k] - (first if z[k] > 0 else -first)) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels):
            keys = [*sorted(set(row)), "bias"]
            own = {k: weight(k, 0.0 if k == "bias" else l1) for k in keys}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(own.values())))))
            for k in keys:
                sigma = (math.sqrt(n[k] + (p - y) ** 2) - math.sqrt(n[k])) / alpha
                z[k] += (p - y) - sigma * own[k]
                n[k] += (p - y) ** 2
    return weight("bias", 0.0), {k: w for k in list(z) if k != "bias" and (w := weight(k, l1))}


def language(text, model, piece, level):
    """The language whose dictionary leaves the fewest bytes, the first of equals; und without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return "und"
    data, best = text.lower().encode(), None
    for lang, content in model:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = 0
        for k in range(0, len(data), piece):
            one = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
            size += len(one.compress(data[k : k + piece]))
        if best is None or size < best[0]:
            best = (size, lang)
    return best[1]
