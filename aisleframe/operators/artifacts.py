"""Page documents: nested rows ready for a JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.operators.leadership import leadership_summary
from aisleframe.operators.market import dispersion_summary
from aisleframe.operators.warehouse import basket_coverage, on_latest_day
from aisleframe.session import settle


def _nest(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """All rows of ``df`` as one sorted array of structs."""
    return df.agg(F.sort_array(F.collect_list(F.struct(*by, *[c for c in df.columns if c not in by]))).alias(name))


def _one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one", "left")
    return out.drop("_one")


def overview_document(overview: DataFrame) -> DataFrame:
    """{supermarkets: [...]}: one entry per retailer."""
    return _nest(overview, "supermarkets", ["supermarket"])


def basket_documents(fact: DataFrame, baskets: DataFrame) -> DataFrame:
    """One document per basket: list size, cost rows and item rows.

    A basket's rows are retailers and its items listed products, both bounded
    by the basket definition.
    """
    sizes = baskets.groupBy("basket").agg(F.count("*").alias("total_items"))
    rows = basket_coverage(fact, baskets).groupBy("basket").agg(
        F.sort_array(F.collect_list(F.struct("supermarket", "basket_cost", "items_found", "coverage_pct"))).alias("rows")
    )
    items = (
        on_latest_day(fact)
        .join(baskets.select("basket", "canonical_name").distinct(), "canonical_name")
        .groupBy("basket")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("canonical_name", "supermarket", F.col("avg_price").cast("double").alias("price")))
            ).alias("items")
        )
    )
    return (
        sizes.join(rows, "basket", "left")
        .join(items, "basket", "left")
        .withColumns({"rows": F.coalesce("rows", F.array()), "items": F.coalesce("items", F.array())})
    )


def dynamics_document(dispersion: DataFrame, leadership: DataFrame) -> DataFrame:
    """Dispersion series, leadership rows and their summaries in one document."""
    # Both are small, made from everything, and used for the rows and for the summary.
    dispersion, leadership = settle(dispersion), settle(leadership)
    series = dispersion.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "dispersion")
    summary = dispersion_summary(dispersion).select("latest_dispersion", "avg_dispersion")
    lead = leadership_summary(leadership).select(
        "top_leader",
        F.when(
            F.col("fastest_leader").isNotNull(),
            F.struct(
                F.col("fastest_follower").alias("follower"),
                F.col("fastest_leader").alias("leader"),
                F.col("fastest_lag_days").alias("median_lag_days"),
            ),
        ).alias("fastest_follower"),
    )
    return _one_row(
        _nest(series, "dispersion", ["date"]), _nest(leadership, "leadership", ["leader", "follower"]), summary, lead
    )


def explorer_meta(contribs: DataFrame) -> DataFrame:
    """Base value, feature names and sample count of a contribution table."""
    return contribs.agg(
        F.first("base_value").alias("base_value"),
        F.sort_array(F.collect_set("feature")).alias("feature_names"),
        F.count_distinct("sample_id").alias("n_samples"),
    )
