"""Ranks over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpointed


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the rank from 1 in ``order``: a range-partitioned sort, and the row counts of the partitions before.

    The sorted rows are checkpointed, so that places and counts are of the same partitions.
    """
    place = F.monotonically_increasing_id()
    held = checkpointed(df.orderBy(*order)).withColumn("_id", place)
    part = F.shiftright("_id", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = held.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return ranked.withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_id", "_part", "_before")
