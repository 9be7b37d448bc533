"""The boundary to models: one interface, and offline stand-ins that need no network.

A provider is a function from texts to texts (or vectors) that runs on the executors, in batches, inside
``mapInPandas``. The stand-ins here are deterministic and say nothing about what a model would answer.
"""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Takes a list of prompts and gives as many answers.
Provider = Callable[[list[str]], list]
#: Seconds before the second try.
WAIT = 1.0
#: The answer of a model that couldn't be asked.
FAILED = "The model could not be asked."
#: Dimensions of embeddings of a provider that doesn't say; a text whose embedding fails gets the zero vector.
DIMS = 64


def asked(provider: Provider, prompts: list[str], tries: int = 3, wait: float = WAIT) -> list[tuple[object, str | None]]:
    """(reply, error) for each prompt; one of the two is null.

    A batch that fails, or comes back with another number of replies, is tried again after ``wait`` seconds, then twice
    as many and so on, and then by halves, so that a bad prompt costs the others of its batch little.
    """
    error = "no reply"
    for k in range(tries):
        try:
            out = list(provider(prompts))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
            return [(r, None) for r in out]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait * (k + 1))
    if len(prompts) <= 1:
        return [(None, error)] * len(prompts)
    half = len(prompts) // 2
    return [r for part in (prompts[:half], prompts[half:]) for r in asked(provider, part, tries if len(part) == 1 else 1, wait)]


def in_order(work: Callable, items: Iterator, in_flight: int) -> Iterator:
    """``work`` of each item, in their order, with as many under way at a time as ``in_flight``; no more are taken from ``items`` ahead."""
    if in_flight <= 1:
        yield from map(work, items)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(work, item))
            if len(waiting) >= in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def call(df: DataFrame, prompt: str, out: str, kind: str, provider: Provider, fallback=None, batch: int = 100, tries: int = 3, wait: float = WAIT, in_flight: int = 1) -> DataFrame:
    """``df`` with ``out``: the provider's answers to ``prompt``, a null prompt being an empty one.

    A prompt that fails gets ``fallback``; see ``asked`` for how batches are tried. Each task has ``in_flight`` batches
    under way at once (a provider must allow for that), so that as many calls run as there are tasks times that number;
    ``coalesce`` before to hold a rate. ``ledger.replies`` keeps what has been answered. Python gets the prompts alone.
    """
    ask = lambda prompts: [fallback if error else r for r, error in asked(provider, prompts, tries, wait)]
    wide = StructType.fromDDL(f"{out} {kind}").fields[0].dataType
    wrapped = StructType([StructField("r", wide)])  # a struct's rows may be of any type

    def answered(own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"r": pd.Series(ask(own.fillna("").tolist()), dtype=object)})

    @F.pandas_udf(wrapped)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts = (own.iloc[lo : lo + batch] for own in batches for lo in range(0, len(own), batch))
        yield from in_order(answered, parts, in_flight)

    # not deterministic: no plan may ask twice for a row, or before others have chosen it
    return df.withColumn(out, run.asNondeterministic()(F.col(prompt))["r"])


def embed(df: DataFrame, text: str, out: str, provider: Provider, dims: int | None = None, wait: float = WAIT) -> DataFrame:
    """``df`` with the text's vector; the zero vector, which is near nothing, where the provider fails.

    It is of the provider's own length, which its attribute ``dims`` tells, unless ``dims`` is given.
    """
    return call(df, text, out, "array<double>", provider, fallback=[0.0] * (dims or getattr(provider, "dims", DIMS)), wait=wait)


def offline_embedding(dims: int = DIMS) -> Provider:
    """Unit vectors from hashed words."""

    def vectors(texts: list[str]) -> list:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for w in text.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    vectors.dims = dims
    return vectors


def offline_answer(prompts: list[str]) -> list[str]:
    """The first sentence of the last line of each prompt."""
    return [(p.strip().split("\n")[-1].split(". ")[0] if p.strip() else "") for p in prompts]


def offline_question(prompts: list[str]) -> list[str]:
    """A labelled question and answer from the prompt's words."""
    return [f"question: what about {' '.join(p.split()[:8])}?\nanswer: {' '.join(p.split()[:24])}" for p in prompts]


def offline_judge(prompts: list[str]) -> list[str]:
    """2, 1 or 0 by how many words the two halves of a prompt, parted by ``|||``, share."""
    out = []
    for p in prompts:
        a, _, b = p.partition("|||")
        a, b = set(a.lower().split()), set(b.lower().split())
        share = len(a & b) / max(1, len(a | b))
        out.append("2" if share >= 0.5 else "1" if share > 0.1 else "0")
    return out
