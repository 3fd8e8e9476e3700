"""Price leadership: which retailer's price moves come first.

A row's lag L is the shift at which the leader's price today correlates best
with the follower's price L positions earlier. A negative lag therefore means
the named leader really moves first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.numeric import safe_corr
from aisleframe.functions.sampling import draw_order, first_k_per_group, sample_rows
from aisleframe.operators.market import multi_retailer_products
from aisleframe.operators.series import SERIES, forward_filled
from aisleframe.session import settle

# Fixed value: below this sample variance a price series counts as constant.
MIN_VARIANCE = 1e-6


def series_eligibility(filled: DataFrame) -> DataFrame:
    """Per series: gap-free from the first date on, and really varying."""
    return (
        filled.groupBy(*SERIES)
        .agg(
            F.count("price").alias("n_prices"),
            F.first("n_dates").alias("n_dates"),
            F.var_samp("price").alias("variance"),
        )
        .withColumn(
            "eligible",
            (F.col("n_prices") == F.col("n_dates")) & F.coalesce(F.col("variance") > MIN_VARIANCE, F.lit(False)),
        )
    )


def series_arrays(filled: DataFrame) -> DataFrame:
    """Eligible series as one array each, in date order.

    The length is the number of distinct dates, bounded by the calendar.
    """
    ordered = F.sort_array(F.collect_list(F.struct("date_idx", "price")))
    return (
        filled.groupBy(*SERIES)
        .agg(
            F.count("price").alias("_n"),
            F.first("n_dates").alias("n_dates"),
            F.var_samp("price").alias("_var"),
            ordered.alias("_points"),
        )
        .filter((F.col("_n") == F.col("n_dates")) & (F.col("_var") > MIN_VARIANCE))
        .select(*SERIES, "n_dates", F.transform("_points", lambda p: p["price"]).alias("prices"))
    )


def store_pairs(arrays: DataFrame) -> DataFrame:
    """Ordered retailer pairs that share a product, one row per pair and product."""
    lead = arrays.select("canonical_name", "n_dates", F.col("supermarket").alias("leader"), F.col("prices").alias("_x"))
    follow = arrays.select("canonical_name", F.col("supermarket").alias("follower"), F.col("prices").alias("_y"))
    return lead.join(follow, "canonical_name").filter(F.col("leader") != F.col("follower"))


def common_date_pairs(daily: DataFrame) -> DataFrame:
    """Ordered retailer pairs on the dates both have a price, one row per pair and product.

    For series with gaps of their own: nothing is filled, the dates of the two
    are intersected, and a lag then counts common dates. ``daily`` has one row
    per retailer, product and date at most; the intersection is an equal join
    by product and date, so it is dealt by date and not by product. Gives the
    columns of ``store_pairs``; arrays are bounded by the calendar.
    """
    priced = daily.filter(F.col("price").isNotNull())
    lead = priced.select("canonical_name", "date", F.col("supermarket").alias("leader"), F.col("price").alias("_a"))
    follow = priced.select("canonical_name", "date", F.col("supermarket").alias("follower"), F.col("price").alias("_b"))
    both = lead.join(follow, ["canonical_name", "date"]).filter(F.col("leader") != F.col("follower"))
    points = F.sort_array(F.collect_list(F.struct("date", "_a", "_b")))
    return (
        both.groupBy("leader", "follower", "canonical_name")
        .agg(points.alias("_points"))
        .select(
            "leader",
            "follower",
            "canonical_name",
            F.size("_points").alias("n_dates"),
            F.transform("_points", lambda p: p["_a"]).alias("_x"),
            F.transform("_points", lambda p: p["_b"]).alias("_y"),
        )
    )


def lag_correlations(pairs: DataFrame, max_lag: int) -> DataFrame:
    """Correlation of leader at t with follower at t - lag, for every lag.

    The arrays are unrolled after the join, next to the partial aggregation,
    so only one partial row per pair, product and lag is shuffled.
    """
    lags = pairs.select("*", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    overlap = lags.filter(F.col("n_dates") - F.abs("lag") >= 2)
    t_from = F.greatest(F.lit(1), F.lit(1) + F.col("lag"))
    t_to = F.least(F.col("n_dates"), F.col("n_dates") + F.col("lag"))
    points = overlap.select("leader", "follower", "canonical_name", "lag", "_x", "_y", F.explode(F.sequence(t_from, t_to)).alias("_t"))
    return (
        points.select(
            "leader",
            "follower",
            "canonical_name",
            "lag",
            F.element_at("_x", F.col("_t")).alias("_a"),
            F.element_at("_y", F.col("_t") - F.col("lag")).alias("_b"),
        )
        .groupBy("leader", "follower", "canonical_name", "lag")
        .agg(safe_corr("_a", "_b").alias("corr"))
    )


def best_lags(correlations: DataFrame, min_correlation: float) -> DataFrame:
    """Lag of the largest absolute correlation (the earliest on a tie), if it clears the bar."""
    return first_k_per_group(
        correlations.filter(F.col("corr").isNotNull()),
        ["leader", "follower", "canonical_name"],
        [F.abs("corr").desc(), F.col("lag").asc()],
        1,
    ).filter(F.abs("corr") > min_correlation)


def price_leadership(
    rows: DataFrame,
    max_lag: int = 7,
    min_correlation: float = 0.15,
    min_stores: int | None = 3,
    sample_size: int | None = None,
    products_per_pair: int | None = None,
    drop_zero: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Median best lag per ordered retailer pair.

    All products sold by ``min_stores`` retailers take part, or, when it is
    given, a draw of ``sample_size`` of them. The variant with ``min_stores=None``, ``products_per_pair=100``,
    ``min_correlation=0.2`` and ``drop_zero=False`` skips the common-product rule.
    """
    # The rows are read once: a mean per retailer, product and day answers all that follows.
    days = settle(rows.groupBy(*SERIES, "date").agg(F.avg("prices").alias("price")))
    chosen = days
    if min_stores is not None:
        names = multi_retailer_products(days, at_least=min_stores).select("canonical_name")
        if sample_size is not None:
            names = sample_rows(names, sample_size, ["canonical_name"], seed)
        chosen = days.join(names, "canonical_name", "left_semi")
    # Each side of a pair would fill the series again.
    arrays = settle(series_arrays(forward_filled(chosen.filter(F.col("price").isNotNull()))))
    pairs = store_pairs(arrays)
    if products_per_pair is not None:
        pairs = first_k_per_group(
            pairs, ["leader", "follower"], [draw_order("canonical_name", seed=seed)], products_per_pair
        )
    result = (
        best_lags(lag_correlations(pairs, max_lag), min_correlation)
        .groupBy("leader", "follower")
        # A median over at most 2 * max_lag + 1 distinct lags: small buffers.
        .agg(F.median("lag").cast("double").alias("median_lag_days"), F.count("*").alias("n_products_analyzed"))
    )
    return result.filter(F.col("median_lag_days") != 0) if drop_zero else result


def leadership_edges(leadership: DataFrame, sign_convention: str = "measured") -> DataFrame:
    """One row per unordered pair, direction taken from the sign of the lag.

    ``measured``: a negative lag means the row's leader moves first.
    ``page``: a lag of zero or more does, as the published page shows it.
    Of two mirrored rows the one with the alphabetically first leader is kept.
    """
    pair = F.array_sort(F.array("leader", "follower"))
    one = first_k_per_group(
        leadership.withColumn("_pair", pair), ["_pair"], [F.col("leader"), F.col("follower")], 1
    )
    lag = F.col("median_lag_days")
    as_named = lag >= 0 if sign_convention == "page" else lag < 0
    edges = one.select(
        F.when(as_named, F.col("leader")).otherwise(F.col("follower")).alias("leader"),
        F.when(as_named, F.col("follower")).otherwise(F.col("leader")).alias("follower"),
        F.abs(lag).alias("lag_days"),
        F.col("n_products_analyzed").alias("n_products"),
    )
    # One row per retailer pair remains: a window over all of them is tiny.
    everything = Window.partitionBy(F.lit(0))
    low, high = F.min("lag_days").over(everything), F.max("lag_days").over(everything)
    strength = F.when(high > low, 1 - (F.col("lag_days") - low) / (high - low)).otherwise(F.lit(1.0))
    return edges.withColumn("strength", strength)


def leadership_matrix(edges: DataFrame, stores: list[str]) -> DataFrame:
    """Leaders by followers, lag days in the cells."""
    return edges.groupBy("leader").pivot("follower", stores).agg(F.first("lag_days"))


def leadership_summary(leadership: DataFrame) -> DataFrame:
    """Most frequent leader, the fastest follower's row, and products analysed in total."""
    fastest = F.min(F.struct(F.abs("median_lag_days").alias("a"), "leader", "follower", "median_lag_days"))
    return leadership.agg(
        F.mode("leader", True).alias("top_leader"),
        fastest.alias("_f"),
        F.sum("n_products_analyzed").alias("total_products"),
    ).select(
        "top_leader",
        F.col("_f.leader").alias("fastest_leader"),
        F.col("_f.follower").alias("fastest_follower"),
        F.col("_f.median_lag_days").alias("fastest_lag_days"),
        "total_products",
    )
