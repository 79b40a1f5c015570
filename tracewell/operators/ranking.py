"""Running sums and row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import checkpoint


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` (a whole number) over the rows of its group up to each row, by ``order``.

    No group is gathered in one task: rows are range-partitioned by group and order together, summed up inside their
    partition, and moved up by what earlier partitions hold of the group (one small row per group and partition).
    Nulls come first; ties in ``order`` are summed up in any order, so it should name a unique column last.
    """
    keys = [*group, *order]
    valued = df.withColumn("__tw_v", value.cast("long"))
    placed = checkpoint(valued.repartitionByRange(*keys).withColumn("__tw_part", F.spark_partition_id()))
    inside = Window.partitionBy("__tw_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__tw_here", F.sum("__tw_v").over(inside))
    held = placed.groupBy("__tw_part", *group).agg(F.sum("__tw_v").alias("__tw_n"))
    before = Window.partitionBy(*group).orderBy("__tw_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__tw_before", F.coalesce(F.sum("__tw_n").over(before), F.lit(0)))
    held = held.where("__tw_before > 0").select(F.col("__tw_part").alias("__tw_p"), *(F.col(g).alias(f"__tw_g{i}") for i, g in enumerate(group)), "__tw_before")
    same = F.col("__tw_part") == F.col("__tw_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__tw_g{i}"))
    joined = summed.join(held, same, "left")
    return joined.withColumn(name, F.col("__tw_here") + F.coalesce("__tw_before", F.lit(0))).select(*df.columns, name)


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's number from 1 in its group, by ``order``; see :func:`running`."""
    return running(df, group, order, F.lit(1), name)
