"""The star schema: two dimensions and the daily price fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_retailer(canonical: DataFrame) -> DataFrame:
    return canonical.select(F.col("supermarket").alias("retailer_name")).distinct().orderBy("retailer_name")


def dim_product(canonical: DataFrame) -> DataFrame:
    """Most frequent category and own-brand flag (ties to the smallest), date range, retailers."""
    return canonical.groupBy("canonical_name").agg(
        F.mode("category", True).alias("category"),
        F.mode("own_brand", True).alias("own_brand"),
        F.min("date").alias("first_seen_date"),
        F.max("date").alias("last_seen_date"),
        F.count_distinct("supermarket").alias("n_retailers"),
    )


def fact_price_daily(canonical: DataFrame) -> DataFrame:
    return canonical.groupBy("canonical_name", "supermarket", "date").agg(
        F.avg("prices").alias("avg_price"),
        F.min("prices").alias("min_price"),
        F.max("prices").alias("max_price"),
        F.count("*").alias("n_listings"),
    )


MARTS = {"dim_retailer": dim_retailer, "dim_product": dim_product, "fact_price_daily": fact_price_daily}
