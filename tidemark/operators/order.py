"""Places in an order over a whole table, without one task that has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose places cut an order into the parts that are ranked apart.
CUTS = 200


def placed(rows: DataFrame, key: Column, name: str, first: int = 1) -> DataFrame:
    """``rows`` with ``name``, the place in the order of ``key`` (which tells all rows apart), from ``first`` on.

    CUTS rows, chosen by a hash, cut the order into parts; a part is ranked by itself, behind the counts of those before it.
    """
    keyed = rows.withColumn("_key", key)
    cuts = keyed.select("_key", F.xxhash64("_key").alias("_h")).orderBy("_h").limit(CUTS).agg(F.collect_list("_key").alias("_cuts"))  # CUTS keys at most
    keyed = keyed.join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")
    counts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    out = keyed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return out.withColumn(name, (place + F.col("_before") + (first - 1)).cast("int")).select(*rows.columns, name)
