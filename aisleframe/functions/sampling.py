"""Samples that depend on row keys only, never on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may order to find the end of a sample.
EDGE_ROWS = 100_000


def draw_order(*keys: str | Column, seed: int = 42) -> Column:
    """Pseudo-random but repeatable sort key for a row with the given keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows in hash order of their keys.

    Counts of the leading hash digits tell where the cut lies: three digits,
    and three more while the rows that share them are many. Rows before the cut
    are taken where they are, and only those that share its digits are ordered.
    """
    keyed = df.withColumn("_draw", draw_order(*keys, seed=seed))
    lead, before, sharing = "", 0, None
    while sharing is None or (sharing > EDGE_ROWS and len(lead) < 12):
        inside = keyed.filter(F.col("_draw").startswith(lead))
        digits = F.substring("_draw", 1, len(lead) + 3)
        # At most 4,096 rows.
        sharing = None
        for r in inside.groupBy(digits.alias("b")).count().orderBy("b").collect():
            if before + r["count"] > n:
                lead, sharing = r["b"], r["count"]
                break
            before += r["count"]
        if sharing is None:
            return keyed.drop("_draw")
    edge = keyed.filter(F.col("_draw").startswith(lead)).orderBy("_draw", *keys).limit(n - before)
    return keyed.filter(F.col("_draw") < lead).unionByName(edge).drop("_draw")


def sample_groups(df: DataFrame, group: str, one_in: int = 10, seed: int = 42) -> DataFrame:
    """All rows of one in ``one_in`` groups (exactly ``groups // one_in`` of them).

    The cut is a position in hash order, found piece by piece, so no group
    list reaches the driver.
    """
    names = df.select(group).filter(F.col(group).isNotNull()).distinct()
    keyed = names.withColumn("_draw", draw_order(group, seed=seed))
    # Hash prefixes split the global order into small independent pieces.
    keyed = keyed.withColumn("_bin", F.substring("_draw", 1, 3))
    sizes = keyed.groupBy("_bin").agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        "_bin",
        F.coalesce(
            F.sum("_n").over(everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.floor(F.sum("_n").over(everything) / F.lit(one_in)).alias("_keep"),
    )
    inside = Window.partitionBy("_bin").orderBy("_draw", group)
    kept = (
        keyed.withColumn("_pos", F.row_number().over(inside))
        .join(sizes, "_bin")
        .filter(F.col("_before") + F.col("_pos") <= F.col("_keep"))
        .select(group)
    )
    return df.join(kept, group, "left_semi")


def first_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Top ``k`` rows per group; Spark trims each map partition to k rows first."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")
