"""How many questions each topic inherits and gets, and which templates are drawn, as window expressions.

The tables here have one row for each topic, so that windows over all of them are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import kept

#: Weights of the three kinds of tasks.
TASK_WEIGHTS = (("factual", 0.7), ("summarization", 0.1), ("multi_hop", 0.2))


def _all():
    return Window.partitionBy(F.lit(0))


def proportions(counts: DataFrame) -> DataFrame:
    """(topic, n) with ``proportion`` n / total; 0 for a total of zero."""
    total = F.sum("n").over(_all())
    return counts.withColumn("proportion", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def inherit_targets(counts: DataFrame, n: int) -> DataFrame:
    """(topic, n, target): floor(n * (count / total)), and all that is left to the largest topic, the first of equals."""
    shares = proportions(counts).withColumn("base", F.floor(F.lit(n) * F.col("proportion")).cast("long"))
    largest = F.row_number().over(_all().orderBy(F.desc("proportion"), "topic")) == 1
    return shares.select("topic", "n", (F.col("base") + F.when(largest, F.lit(n) - F.sum("base").over(_all())).otherwise(F.lit(0))).cast("long").alias("target"))


def inherit_plan(targets: DataFrame, available: DataFrame) -> DataFrame:
    """(topic, target, available, inherit, generate): as many as there are up to the target are inherited, the gap is generated."""
    both = targets.join(available, "topic", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    inherit = F.least("target", "available")
    return both.select("topic", "target", "available", inherit.alias("inherit"), (F.col("target") - inherit).alias("generate"))


def plan_summary(plan: DataFrame, previous: Column) -> DataFrame:
    """inherit_count, discarded (previous less inherited), candidate_count, generation_needed."""
    inherited = F.coalesce(F.sum("inherit"), F.lit(0))
    return plan.agg(inherited.alias("inherit_count"), (previous - inherited).alias("discarded"), F.coalesce(F.sum("available"), F.lit(0)).alias("candidate_count"), F.coalesce(F.sum("generate"), F.lit(0)).alias("generation_needed"))


def sampler_allocation(topics: DataFrame, n: int) -> DataFrame:
    """(topic, need, allocated) for topics (topic, proportion, inherited, n_templates).

    The ideal share of all pairs less what is inherited, taken in order of proportion until ``n`` is used up,
    by topics that have templates; what is left goes round, one to each in the same order.
    """
    inherited = F.sum("inherited").over(_all())
    own = topics.withColumn("need", F.greatest(F.lit(0), F.floor((F.lit(n) + inherited) * F.col("proportion")).cast("long") - F.col("inherited"))).where("n_templates > 0")
    order = _all().orderBy(F.desc("proportion"), "topic")
    before = F.coalesce(F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("greedy", F.least(F.col("need"), F.greatest(F.lit(0), F.lit(n) - before)))
    rank, m = F.row_number().over(order) - 1, F.count("*").over(_all())
    left = F.lit(n) - F.sum("greedy").over(_all())
    more = F.floor(left / m) + F.when(rank < left % m, 1).otherwise(0)
    return own.select("topic", "need", (F.col("greedy") + more).cast("long").alias("allocated"))


def seeded_order(key: Column, seed: str = "42") -> Column:
    """A hash that puts keys in an order of chance, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


#: Hex digits of a row's hash that a topic's rows are counted by, and topics up to which their cuts are broadcast.
CUT_DIGITS, BROADCAST_TOPICS = 3, 100_000


def first_of_each(rows: DataFrame, quota: DataFrame, by: str, order: Column, key: str) -> DataFrame:
    """The first ``allocated`` rows of each ``by`` of ``quota`` (by, allocated) in the order of a hex hash, then of ``key``.

    Rows are counted by the first digits of their hashes, which sums up from any number of tasks to a row for each topic and
    beginning. The sums tell up to which beginning all rows are in, and how many of the next one: these alone, a
    4096th of a topic, are ranked. A topic with fewer rows than allocated has all of them in.
    """
    quota = quota.select(by, F.col("allocated").cast("long").alias("_allocated")).where("_allocated > 0")
    hashed = rows.withColumn("_hash", order).withColumn("_part", F.substring("_hash", 1, CUT_DIGITS))
    counts = hashed.groupBy(by, "_part").agg(F.count("*").alias("_n")).join(quota, by)
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy("_part"))
    counts = counts.withColumn("_upto", upto)
    # the beginning that the quota ends in, and what it still takes of it; none where the topic has no more than its quota
    cuts = counts.where("_upto > _allocated and _upto - _n <= _allocated").groupBy(by).agg(F.min_by(F.struct(F.col("_part").alias("cut"), (F.col("_allocated") - F.col("_upto") + F.col("_n")).alias("need")), "_part").alias("c"))
    cuts = kept(quota.join(cuts, by, "left").select(by, F.col("c.cut").alias("_cut"), F.coalesce("c.need", F.lit(0)).alias("_need")), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_TOPICS else cuts
    met = hashed.join(cuts, by)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_hash", key))
    last = met.where("_part = _cut").withColumn("_rank", rank).where("_rank <= _need").drop("_rank")
    return met.where("_cut is null or _part < _cut").unionByName(last).select(*rows.columns)


def stratified_sample(rows: DataFrame, quota: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """At most ``allocated`` rows of each topic, without replacement; what a topic lacks isn't made up elsewhere."""
    return first_of_each(rows, quota, "topic", seeded_order(F.col(key), seed), key)


def uniform(key: Column, seed: str = "42") -> Column:
    """A number of [0, 1) from the first seven hex digits of a hash."""
    return F.conv(F.substring(seeded_order(key, seed), 1, 7), 16, 10).cast("double") / float(16**7)


def choose_task(key: Column, weights=TASK_WEIGHTS, seed: str = "42") -> Column:
    """One of the tasks by its weight, renormalised over those given."""
    total, acc, out = sum(w for _, w in weights), 0.0, None
    u = uniform(key, seed)
    for name, w in weights:
        acc += w
        out = F.when(u < acc / total, name) if out is None else out.when(u < acc / total, name)
    return out.otherwise(weights[-1][0])


def random_template(templates: DataFrame, key: str, topic: str | None = None, seed: str = "42") -> DataFrame:
    """One template, of one topic if given; an error if there is none."""
    own = templates if topic is None else templates.where(F.col("topic") == topic)
    picked = own.orderBy(seeded_order(F.col(key), seed), key).limit(1)
    if picked.isEmpty():
        raise ValueError("no template")
    return picked


def budgeted_resample(targets: DataFrame, n: int) -> DataFrame:
    """(topic, base, extra) for (topic, target, available): min of both, and a budget of min(0.6 n, allocated + 20) less
    what is allocated, spread by target over topics that have more. None has, so that ``extra`` is 0 throughout."""
    base = F.least("target", "available")
    return targets.select("topic", base.alias("base"), F.greatest(F.lit(0), F.least(F.col("available"), F.col("target")) - base).alias("extra"))


def remaining_target(planned: Column, n: int, inherited: Column) -> Column:
    """The planned number, else what is left of ``n``."""
    return F.coalesce(planned, F.greatest(F.lit(0), F.lit(n) - inherited))


def test_sample(sampled: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` of the rows, in the order of a seeded hash of the key: the test mode's cap."""
    all_of = sampled.sparkSession.createDataFrame([(0, size)], "_all int, allocated long")
    return first_of_each(sampled.withColumn("_all", F.lit(0)), all_of, "_all", seeded_order(F.col(key), str(seed)), key).drop("_all")
