"""Daily series on a common date grid: forward fill and seasonal decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["supermarket", "canonical_name"]


def daily_series(rows: DataFrame) -> DataFrame:
    """Mean price per retailer, product and day."""
    return (
        rows.filter(F.col("prices").isNotNull())
        .groupBy(*SERIES, "date")
        .agg(F.avg("prices").alias("price"))
    )


def date_index(rows: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Position of each date among the dates seen (from 1), and how many there are.

    Works on distinct dates only; their number is bounded by the calendar.
    """
    within = within or []
    days = rows.select(*within, "date").distinct()
    grid = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return days.select(
        *within,
        "date",
        F.row_number().over(grid.orderBy("date")).alias("date_idx"),
        F.count("*").over(grid).alias("n_dates"),
    )


def forward_filled(daily: DataFrame, within: list[str] | None = None, keep_leading: bool = True) -> DataFrame:
    """Carry each price forward over the grid until the series' next price.

    An observation is repeated over the positions up to the next one, so no
    dense grid is joined. Positions before the first price are null rows, or
    left out. Result: series columns, ``date_idx``, ``n_dates``, ``price``.
    """
    within = within or []
    indexed = daily.join(date_index(daily, within), [*within, "date"])
    order = Window.partitionBy(*SERIES).orderBy("date_idx")
    first = F.lag("date_idx", 1).over(order).isNull()
    until = F.coalesce(F.lead("date_idx", 1).over(order) - 1, F.col("n_dates"))
    start = F.when(first, F.lit(1)).otherwise(F.col("date_idx")) if keep_leading else F.col("date_idx")
    spans = indexed.select(
        *SERIES,
        "n_dates",
        "price",
        F.col("date_idx").alias("_from"),
        F.sequence(start.cast("long"), until.cast("long")).alias("_span"),
    )
    dense = spans.select(*SERIES, "n_dates", "price", "_from", F.explode("_span").alias("_i"))
    return dense.select(
        *SERIES,
        F.col("_i").cast("int").alias("date_idx"),
        F.col("n_dates").cast("int").alias("n_dates"),
        F.when(F.col("_i") >= F.col("_from"), F.col("price")).alias("price"),
    )


def seasonal_decompose(daily: DataFrame, period: int = 7) -> DataFrame:
    """Additive decomposition of every series with at least two full periods.

    The grid is the product's own dates; gaps are filled forward and the part
    before a retailer's first price is left out. Trend is the centred moving
    average over an odd period; the seasonal part is the mean of each phase
    less the mean over phases; the rest is the residual.
    """
    if period % 2 == 0:
        raise ValueError("period must be odd")
    half = period // 2
    filled = forward_filled(daily, within=["canonical_name"], keep_leading=False)
    series = Window.partitionBy(*SERIES)
    order = series.orderBy("date_idx")
    centred = order.rowsBetween(-half, half)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = filled.select(
        *SERIES,
        "date_idx",
        F.col("price").alias("observed"),
        F.row_number().over(order).alias("_rn"),
        F.count("*").over(whole).alias("_len"),
        F.when(F.count("*").over(centred) == period, F.avg("price").over(centred)).alias("trend"),
    ).filter(F.col("_len") >= 2 * period)
    rows = rows.withColumn("_phase", (F.col("_rn") - 1) % period).withColumn("_detrended", F.col("observed") - F.col("trend"))
    # Phase means as conditional averages keep the series partitioning: no further exchange.
    means = [F.avg(F.when(F.col("_phase") == p, F.col("_detrended"))).over(series) for p in range(period)]
    rows = rows.withColumn("_means", F.array(*means))
    overall = F.aggregate("_means", F.lit(0.0), lambda acc, m: acc + m) / period
    rows = rows.withColumn("seasonal", F.element_at("_means", (F.col("_phase") + 1).cast("int")) - overall)
    return rows.select(
        *SERIES,
        "date_idx",
        "observed",
        "trend",
        "seasonal",
        (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )
