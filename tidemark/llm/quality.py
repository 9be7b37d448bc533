"""Quality rules as one projection: counts of a text, then thresholds over their ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
# Frequent function words of the languages that the rules know.
STOP_WORDS = """
a an and are as at be by for from has he in is it its of on or that the this to was were will with
au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se sur un une
als auch auf aus das dem den der des die ein eine er für ich im in ist mit nicht sich sie und von war zu
al como con de del el en es esta la las lo los no para pero por que se su un una y
""".split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str = "1"
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        checks = [f"({self.numerator}) {sign} {float(bound)!r}D * ({self.denominator})" for sign, bound in ((">=", self.low), ("<=", self.high)) if bound is not None]
        return F.expr(" and ".join(checks) or "true")


#: The threshold table over the counts of ``measure``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("letters", "n_letter_words", "n_words", 0.5, None),
    Rule("stop_words", "n_stop_words", "least(n_words, 1)", 2.0, None),
)
BASE = (Rule("words", "n_words", "1", 50, None), Rule("repeated_words", "100 * n_repeat_words", "n_words", None, 50))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_stop_words")
_STEPS = ("_t", "_w", "_l", "_h", "_s", "_p")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use. A null text counts as empty.

    Windows of three words that are found again are told from their sorted (hash, place) pairs, so a text of
    n words takes n log n steps, and only if it has any such window at all.
    """
    docs = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn("_w", F.array_remove(F.split("_t", SPACES), "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    # the words' hashes are a variable: a slice of a row's own column copies the whole of it for each window
    windows = "if(size(v) < 3, cast(array() as array<bigint>), transform(sequence(1, size(v) - 2), i -> xxhash64(slice(v, i, 3))))"
    docs = docs.withColumn("_h", F.expr(f"element_at(transform(array(transform(_w, x -> xxhash64(x))), v -> {windows}), 1)"))
    docs = docs.withColumn("_s", F.expr("if(size(_h) = size(array_distinct(_h)), array(), sort_array(zip_with(_h, sequence(1, size(_h)), (h, i) -> struct(h, i))))"))
    again = "transform(filter(sequence(1, size(_s)), k -> (k > 1 and _s[k - 2].h = _s[k - 1].h) or (k < size(_s) and _s[k].h = _s[k - 1].h)), k -> _s[k - 1].i)"
    docs = docs.withColumn("_p", F.expr(f"if(size(_s) = 0, array(), sort_array({again}))"))
    # each window covers three words, less those that the window before it covers already
    covered = "aggregate(_p, struct(0 as n, -3 as at), (s, p) -> struct(s.n + least(3, p - s.at) as n, p as at), s -> cast(s.n as bigint))"
    return docs.select(
        *(c for c in docs.columns if c not in _STEPS),
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``failed`` (names of the rules failed) and ``kept``.

    Repeated rows are judged alike; empty tables stay empty; a column that has the name of a count is replaced.
    """
    docs = measure(docs.drop(*(c for c in (*COUNTS, "base_failed", "failed", "kept", *_STEPS) if c != text)), text)
    failed = F.filter(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    bad = ~base[0].passes()
    for r in base[1:]:
        bad = bad | ~r.passes()
    return docs.withColumn("base_failed", bad).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
