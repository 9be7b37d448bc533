"""Model calls that fail, come short or are lost, and replies that are kept."""

import os
import threading
import time

from pyspark.sql import functions as F

from tidemark.plans.ledger import replies
from tidemark.plans.providers import asked, call, embed, in_order, offline_embedding


def logged(folder, fail=lambda p: False, short=lambda ps: False):
    """A provider that notes each prompt it answers in a file of its own name."""

    def provider(prompts):
        if any(fail(p) for p in prompts):
            raise RuntimeError("no")
        if short(prompts):
            return ["too few"]
        for p in prompts:
            with open(os.path.join(folder, f"{len(p)}-{abs(hash(p))}-{time.time_ns()}-{threading.get_ident()}"), "w") as f:
                f.write(p)
        return [p.upper() for p in prompts]

    return provider


def notes(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_batches_fail_by_prompt():
    calls = []

    def provider(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("bad")
        return prompts if len(prompts) < 3 else prompts[1:]

    got = asked(provider, ["a", "b", "bad", "c", "d"], tries=2, wait=0)
    assert [r for r, _ in got] == ["a", "b", None, "c", "d"] and got[2][1] == "ValueError: bad"
    assert len(calls) <= 12 and asked(provider, [], wait=0) == []
    assert asked(lambda p: [], ["x"], wait=0) == [(None, "ValueError: 0 replies to 1 prompts")]


def test_work_in_flight_stays_in_order_and_bounded():
    now, most, taken = [0], [0], []
    lock = threading.Lock()

    def work(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (k % 3))
        with lock:
            now[0] -= 1
        return k

    def items():
        for k in range(20):
            taken.append(k)
            yield k

    out = in_order(work, items(), 4)
    assert next(out) == 0 and len(taken) <= 5
    assert list(out) == list(range(1, 20)) and 1 < most[0] <= 4
    assert list(in_order(work, iter([3, 1]), 1)) == [3, 1]


def test_call_takes_short_replies_for_errors(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(9)], "k long, p string").coalesce(1)
    got = call(rows, "p", "o", "string", lambda ps: ps[:1], fallback="none", batch=4, tries=1, wait=0, in_flight=3)
    assert sorted((r["k"], r["o"]) for r in got.collect()) == [(k, f"p{k}") for k in range(9)]


def test_a_failed_embedding_has_the_provider_s_length(spark):
    def none(texts):
        raise RuntimeError

    none.dims = 5
    rows = spark.createDataFrame([("x",)], "t string")
    assert embed(rows, "t", "v", none, wait=0).first()["v"] == [0.0] * 5
    assert len(embed(rows, "t", "v", offline_embedding(7)).first()["v"]) == 7


def test_no_prompt_is_asked_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.ledger.ROUND", 10)
    root, notebook = str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(notebook)
    rows = spark.createDataFrame([(k, f"p{k % 25}" if k % 10 else None, "old") for k in range(100)], "k long, p string, o string").repartition(3)
    failing = logged(notebook, fail=lambda p: p in ("p3", "p14"), short=lambda ps: len(ps) > 4)
    ask = lambda df, provider, version="1": replies(df, "p", "o", "string", provider, root, "model", version, fallback="none", batch=8, tries=1, wait=0)
    got = {r["k"]: (r["o"], r["o_error"]) for r in ask(rows, failing).collect()}
    assert len(got) == 100 and got[10] == ("", None) and got[1] == ("P1", None) and got[3][0] == "none" and "RuntimeError" in got[3][1]
    first = notes(notebook)
    assert len(first) == len(set(first)) and not {"p3", "p14"} & set(first)
    good = logged(notebook)
    got = ask(rows.union(spark.createDataFrame([(100, "new", "x")], rows.schema)), good)
    assert got.columns == ["k", "p", "o", "o_error"] and {r["o"] for r in got.where("k in (3, 14, 100)").collect()} == {"P3", "P14", "NEW"}
    assert sorted(set(notes(notebook)) - set(first)) == ["new", "p14", "p3"] and len(notes(notebook)) == len(first) + 3
    assert ask(rows, good).where(F.col("o_error").isNotNull()).count() == 0 and len(notes(notebook)) == len(first) + 3
    assert ask(rows.where("k = 1"), good, "2").first()["o"] == "P1" and len(notes(notebook)) == len(first) + 4  # another version


def test_a_run_that_stops_keeps_its_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.ledger.ROUND", 10)
    root, notebook = str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(notebook)
    from tidemark.sources.commits import CommitLog

    rows = spark.createDataFrame([(f"p{k}",) for k in range(40)], "p string")
    append, rounds = CommitLog.append, []

    def stops(self, df, **info):
        rounds.append(1)
        if len(rounds) == 3:
            raise KeyboardInterrupt
        return append(self, df, **info)

    monkeypatch.setattr(CommitLog, "append", stops)
    ask = lambda: replies(rows, "p", "o", "string", logged(notebook), root, "model")
    try:
        ask()
        raise AssertionError
    except KeyboardInterrupt:
        pass
    before = len(notes(notebook))
    monkeypatch.setattr(CommitLog, "append", append)
    assert 0 < before < 40 and ask().where("o = upper(p)").count() == 40 and len(notes(notebook)) == 40
