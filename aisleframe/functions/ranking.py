"""Positions in a global order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.session import settle


def with_rank(df: DataFrame, order: list[Column], within: str | None = None, name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... in the order given, starting anew for each value of ``within``.

    Rows are range-partitioned; a row's rank is its position inside its
    partition plus the rows of the partitions before it. The counts that say so
    have a row per partition and value of ``within``, joined by both. The
    partitioned rows are written first: made anew after the loss of an executor
    they might be cut elsewhere.
    """
    group = [F.lit(0) if within is None else F.col(within)]
    dealt = settle(df.withColumn("_group", group[0]).repartitionByRange(F.col("_group"), *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_group", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order))
    keys = [F.col("d._group").eqNullSafe(F.col("b._group")), F.col("d._part") == F.col("b._part")]
    return (
        dealt.withColumn("_inside", inside)
        .alias("d")
        .join(before.alias("b"), keys)
        .select("d.*", (F.col("d._inside") + F.col("b._before")).cast("long").alias(name))
        .drop("_group", "_part", "_inside")
    )
