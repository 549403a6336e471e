"""Exact ranks inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 1024


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """``df`` with ``name``, the rank from 0 within ``group`` in the order of the columns ``order``, the first a long hash.

    The hash's value range is cut into ``salts`` runs. Rows are ranked within (group, run), and the rows of the
    earlier runs, counted before the shuffle, are added. Rows equal in all of ``order`` share out their ranks at random.
    """
    run = f"_{name}_run"
    keyed = df.withColumn(run, F.shiftrightunsigned(order[0], 64 - (salts - 1).bit_length()).cast("int"))
    held = keyed.groupBy(*group, run).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = Window.partitionBy(*group, run).orderBy(*order)
    local = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    held = held.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col(run).alias("_run"), "_before")
    same = F.col(run) == F.col("_run")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return local.join(held, same).withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop(run, "_inside", "_before", "_run", *[f"_g{k}" for k in range(len(group))])
