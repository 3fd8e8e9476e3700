"""Data-quality profiles of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.quantiles import exact_quantiles


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column_name, nulls) from one pass over the table."""
    one_row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = one_row.unpivot([], df.columns, "column_name", "nulls")
    return long.filter("nulls > 0") if only_positive else long


def quality_probes(df: DataFrame) -> DataFrame:
    """Zero prices and missing or zero unit prices, in one row."""
    zero_unit = F.coalesce(F.col("prices_unit") == 0, F.lit(True))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("prices") == 0).alias("zero_price"),
        F.count_if(zero_unit).alias("zero_or_missing_unit_price"),
        F.count_if(zero_unit & (F.col("prices") > 0)).alias("priced_without_unit_price"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column."""
    c = F.col(column).cast("double")
    head = df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    ).withColumn("_one", F.lit(1))
    quartiles = exact_quantiles(df, [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumn("_one", F.lit(1))
    return head.join(quartiles, "_one", "left").drop("_one")


def row_loss(before: DataFrame, after: DataFrame, stage: Column, warn_above: float = 0.2) -> DataFrame:
    """Rows in and out of a stage, and whether more than ``warn_above`` of them were lost."""
    n_in = before.agg(F.count("*").alias("rows_in")).withColumn("_one", F.lit(1))
    n_out = after.agg(F.count("*").alias("rows_out")).withColumn("_one", F.lit(1))
    lost = F.greatest(F.lit(0.0), F.try_divide(F.col("rows_in") - F.col("rows_out"), F.col("rows_in")))
    return (
        n_in.join(n_out, "_one")
        .select(stage.alias("stage"), "rows_in", "rows_out", (F.col("rows_out") - F.col("rows_in")).alias("row_delta"))
        .withColumn("loss_fraction", lost)
        .withColumn("warn", F.coalesce(F.col("loss_fraction") > warn_above, F.lit(False)))
    )
