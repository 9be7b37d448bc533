"""Work by batches that stops in the middle and goes on."""

from pyspark.sql import functions as F

from tidemark.operators.order import placed
from tidemark.plans.batches import left_over, made, run_batches
from tidemark.sources.commits import CommitLog


def test_a_stopped_run_goes_on_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"t{k}", k) for k in range(50)], "id string, k long").repartition(3)
    calls, root = [], str(tmp_path / "b")

    def make(own):
        calls.append(own.count())
        return own.where("k % 2 = 0").select("id", (F.col("k") * 2).alias("twice"))  # half of the rows give nothing

    commit, seen = CommitLog.commit, []

    def stops(self, *a, **b):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        return commit(self, *a, **b)

    monkeypatch.setattr(CommitLog, "commit", stops)
    try:
        run_batches(rows, root, make, "id", 12)
        raise AssertionError
    except KeyboardInterrupt:
        pass
    log = CommitLog(spark, root)
    assert left_over(rows, log, "id").count() == 26 and len(log.state()[1]) == 2
    monkeypatch.setattr(CommitLog, "commit", commit)
    log = run_batches(rows, root, make, "id", 12)
    assert calls == [12, 12, 12, 12, 12, 2]
    assert sorted((r["id"], r["twice"]) for r in log.read().collect()) == sorted((f"t{k}", 2 * k) for k in range(0, 50, 2))
    before = log.state()
    assert run_batches(rows, root, make, "id", 12).state() == before and len(calls) == 6
    more = run_batches(rows.union(spark.createDataFrame([("new", 98)], rows.schema)), root, make, "id", 12)
    assert made(more) == 26 and len(log.vacuum()) == 1 and made(more) == 26


def test_a_target_ends_a_run(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "k")
    log = run_batches(rows, str(tmp_path / "b"), lambda own: own, "k", 10, target=25)
    assert made(log) == 30 and made(run_batches(rows, str(tmp_path / "b"), lambda own: own, "k", 10, target=25)) == 30
    assert made(run_batches(rows, str(tmp_path / "b"), lambda own: own, "k", 10, most=2)) == 50


def test_places_are_those_of_one_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("_h"))
    got = placed(rows.repartition(4), F.col("k"), "at", 0)
    assert got.columns == ["k", "_h", "at"] and all(r["k"] == r["at"] for r in got.collect())
    assert placed(rows.limit(0), F.col("k"), "at").count() == 0
