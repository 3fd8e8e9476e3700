"""Market structure: concentration, dispersion, cross-retailer spread, volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the first two concentration classes, both inclusive.
COMPETITIVE_UP_TO = 1500
MODERATE_UP_TO = 2500


def hhi(rows: DataFrame, group_col: str = "category") -> DataFrame:
    """Sum of squared percentage shares of listing rows, per group, with its class."""
    group_col = group_col if group_col in rows.columns else "canonical_name"
    counts = rows.groupBy(group_col, "supermarket").agg(F.count("*").alias("n"))
    # One row per retailer and group is left here, so the group window is small.
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group_col))
    index = (
        counts.withColumn("_sq", F.pow(share * 100, F.lit(2.0)))
        .groupBy(group_col)
        .agg(F.bround(F.sum("_sq"), 0).cast("int").alias("hhi"))
    )
    level = (
        F.when((F.col("hhi") > 0) & (F.col("hhi") <= COMPETITIVE_UP_TO), "Competitive")
        .when((F.col("hhi") > COMPETITIVE_UP_TO) & (F.col("hhi") <= MODERATE_UP_TO), "Moderate")
        .when((F.col("hhi") > MODERATE_UP_TO) & (F.col("hhi") <= 10001), "Highly Concentrated")
    )
    return index.withColumn("concentration", level)


def dispersion(rows: DataFrame) -> DataFrame:
    """Daily mean over products of std / mean of the day's prices."""
    per_product = rows.groupBy("canonical_name", "date").agg(
        F.avg("prices").alias("_mean"), F.stddev_samp("prices").alias("_std")
    )
    spread = F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(F.lit(0.0))
    return per_product.groupBy("date").agg(F.avg(spread).alias("dispersion"))


def rolling_mean(series: DataFrame, value: str, length: int = 7) -> DataFrame:
    """Mean of the last ``length`` days of a daily series, null until that many exist.

    The input has one row per calendar day, so its single window is small.
    """
    frame = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(length - 1), 0)
    full = F.count(F.col(value)).over(frame) == length
    return series.withColumn(f"{value}_{length}d", F.when(full, F.avg(value).over(frame)))


def dispersion_summary(series: DataFrame) -> DataFrame:
    """Latest, mean, range and the 0-100 competitiveness index (100 when flat)."""
    out = series.agg(
        F.max_by("dispersion", "date").alias("latest_dispersion"),
        F.avg("dispersion").alias("avg_dispersion"),
        F.min("dispersion").alias("min_dispersion"),
        F.max("dispersion").alias("max_dispersion"),
    )
    width = F.col("max_dispersion") - F.col("min_dispersion")
    position = (F.col("latest_dispersion") - F.col("min_dispersion")) / width
    return out.withColumn("competitiveness_index", F.when(width > 0, (1 - position) * 100).otherwise(F.lit(100.0)))


def multi_retailer_products(rows: DataFrame, name: str = "canonical_name", at_least: int = 2) -> DataFrame:
    return (
        rows.groupBy(name)
        .agg(F.count_distinct("supermarket").alias("n_retailers"))
        .filter(F.col("n_retailers") >= at_least)
    )


def shared_products(rows: DataFrame, store_a: str, store_b: str, name: str = "canonical_name") -> DataFrame:
    """Products that both retailers list."""
    pick = rows.select(name, "supermarket")
    a = pick.filter(F.col("supermarket") == store_a).select(name)
    b = pick.filter(F.col("supermarket") == store_b).select(name)
    return a.intersect(b)


def price_spread(latest_prices: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Lowest and highest retailer price, their gap and the cheapest retailer per product."""
    per_store = latest_prices.groupBy(name, "supermarket").agg(F.avg("prices").alias("price"))
    return per_store.groupBy(name).agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        (F.max("price") - F.min("price")).alias("price_spread"),
        F.min(F.struct("price", "supermarket")).getField("supermarket").alias("cheapest_supermarket"),
    )


def cheapest_counts(spread: DataFrame) -> DataFrame:
    return spread.groupBy("cheapest_supermarket").agg(F.count("*").alias("n_products"))


def volatility(rows: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Standard deviation of a product's prices; single observations drop out."""
    return rows.groupBy(name).agg(F.stddev_samp("prices").alias("volatility")).na.drop(subset=["volatility"])


def volatility_extremes(vol: DataFrame, n: int = 10, name: str = "canonical_name") -> DataFrame:
    """The ``n`` most and the ``n`` least volatile products."""
    most = vol.orderBy(F.desc("volatility"), name).limit(n).withColumn("side", F.lit("most"))
    least = vol.orderBy("volatility", name).limit(n).withColumn("side", F.lit("least"))
    return most.unionByName(least)
