"""Past-only price features per listing and market position per product and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.calendar import cyclical_parts
from aisleframe.functions.levels import POSITION, with_position

LISTING = ["supermarket", "product_name"]
MARKET_DAY = ["canonical_name", "date"]
ROLLING_WINDOWS = [7, 14, 30]
LAGS = [1, 7]
CHEAPEST = "is_cheapest_in_market"


def listing_day(df: DataFrame) -> DataFrame:
    """One row per retailer, listing and day.

    Prices are averaged, other columns take their smallest value.

    Step one groups by all non-price columns: only numbers are in the buffers,
    so it is a hash aggregation, and repeated rows of a hot listing collapse
    before the shuffle. What is left is at most one row per day and variant of
    a listing, which bounds the second step and every later window. Step two
    shares its partitioning and sort order with those windows.
    """
    keys = [*LISTING, "date"]
    means = [c for c in ("prices", "prices_unit") if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c not in means]
    variants = df.groupBy(*keys, *rest).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in means], *[F.count(c).alias(f"_n_{c}") for c in means]
    )
    days = (
        variants.repartition(*LISTING)
        .groupBy(*keys)
        .agg(
            *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(c) for c in means],
            *[F.min(c).alias(c) for c in rest],
        )
    )
    return days.select(*df.columns)


def temporal_features(
    df: DataFrame,
    windows: list[int] = ROLLING_WINDOWS,
    lags: list[int] = LAGS,
    include_current: bool = False,
    series: list[str] = LISTING,
    ties: list[str] | None = None,
) -> DataFrame:
    """Rolling statistics, lags, last known move and gap, from earlier rows only.

    Expects one row per series and day; where there are more, ``ties`` names
    the columns that order them. All frames share one partitioning and
    one order, so the plan has a single exchange, sort and window.
    ``include_current`` gives the legacy frames that end at the row itself;
    those leak the price being predicted and exist for comparison only.
    """
    past = Window.partitionBy(*series).orderBy("date", *(ties or []))
    price = F.col("prices")
    cols = {}
    for w in windows:
        frame = past.rowsBetween(-(w - 1), 0) if include_current else past.rowsBetween(-w, -1)
        cols[f"price_rol_mean_{w}d"] = F.avg(price).over(frame)
        cols[f"price_rol_std_{w}d"] = F.stddev_samp(price).over(frame)
        cols[f"price_rol_max_{w}d"] = F.max(price).over(frame)
        cols[f"price_rol_min_{w}d"] = F.min(price).over(frame)
    for k in lags:
        cols[f"price_lag_{k}d"] = F.lag(price, k).over(past)
    if include_current:
        cols["price_diff_1d"] = price - F.lag(price, 1).over(past)
    else:
        cols["price_diff_1d"] = F.lag(price, 1).over(past) - F.lag(price, 2).over(past)
    cols["days_since_last_obs"] = F.date_diff("date", F.lag("date", 1).over(past)).cast("double")
    return df.select("*", *[c.alias(name) for name, c in cols.items()])


def legacy_features(df: DataFrame, windows: list[int] = ROLLING_WINDOWS, lags: list[int] = LAGS) -> DataFrame:
    """Self-inclusive rolling features of a product at a retailer, nulls filled with 0."""
    out = temporal_features(df, windows, lags, include_current=True, series=["supermarket", "canonical_name"])
    filled = [c for c in out.columns if "rol_std" in c or "lag" in c or "diff" in c]
    return out.drop("days_since_last_obs").na.fill(0.0, subset=filled)


def cheapest() -> Column:
    return F.coalesce((F.col("price_rank") == 1).cast("int"), F.lit(0))


def competitive_features(
    df: DataFrame, price_col: str = "price_lag_1d", sizes: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Own previous price against the other listings of the product that day.

    The mean of the others is (sum - own) / (n - 1); the rank is one plus the
    listings strictly below. Without another listing both are null.
    """
    out = with_position(df, MARKET_DAY, price_col, sizes, hot_rows)
    own = F.col(price_col)
    contested = F.col("_count") > 1
    delta = F.when(contested, own - (F.col("_sum") - own) / (F.col("_count") - 1))
    rank = F.when(contested, (F.col("_lower") + 1).cast("double"))
    return (
        out.withColumns({"price_vs_market_avg": delta, "price_rank": rank})
        .withColumn(CHEAPEST, cheapest())
        .drop(*POSITION)
    )


def inclusive_market_stats(df: DataFrame, sizes: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Legacy market statistics of a product and day that include the row itself."""
    stats = df.groupBy(*MARKET_DAY).agg(
        F.avg("prices").alias("market_avg_price"),
        F.stddev_samp("prices").alias("market_std_price"),
        F.min("prices").alias("market_min_price"),
        F.max("prices").alias("market_max_price"),
    )
    ranked = with_position(df, MARKET_DAY, "prices", sizes, hot_rows)
    return (
        ranked.join(stats, MARKET_DAY, "left")
        .withColumns(
            {
                "price_vs_market_avg": F.col("prices") - F.col("market_avg_price"),
                "price_rank": (F.col("_lower") + 1).cast("double"),
                "is_cheapest": (F.col("prices") == F.col("market_min_price")).cast("int"),
            }
        )
        .drop(*POSITION)
    )


def cyclical_features(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclical_parts(F.col("date")))


def feature_frame(
    canonical: DataFrame, windows: list[int] = ROLLING_WINDOWS, lags: list[int] = LAGS
) -> DataFrame:
    """Canonical rows to the full feature table."""
    daily = temporal_features(listing_day(canonical), windows, lags)
    return cyclical_features(competitive_features(daily, sizes=canonical))


def with_first_listing(df: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether a row is the one of the least listing name of its product, retailer and day."""
    group = Window.partitionBy(*MARKET_DAY, LISTING[0]).orderBy(F.col(LISTING[1]).asc())
    return df.withColumn(name, F.row_number().over(group) == 1)


def keyed_feature_frame(
    observed: DataFrame,
    listings: DataFrame,
    key: str,
    prices: dict[str, Column],
    windows: list[int] = ROLLING_WINDOWS,
    lags: list[int] = LAGS,
    first_listing: str | None = None,
) -> DataFrame:
    """``feature_frame`` of ``observed`` joined to ``listings`` by ``key``, whose columns do not travel with the rows.

    ``observed`` has the key, retailer and date, and what ``prices`` (column
    name to value) are made of. Every key has one row in ``listings``, and a
    listing of a retailer one key. Rows move three times, with keys and
    numbers alone: to their key, to the product and day with the price that is
    compared, and back to their key, where rolling statistics are made and the
    other columns are joined. ``first_listing`` names a column to add, see ``with_first_listing``.
    """
    retailer, canonical = LISTING[0], MARKET_DAY[0]
    series = [key, retailer]
    told = [canonical] if first_listing is None else [canonical, LISTING[1]]
    daily = (
        observed.repartition(key)
        .join(listings.select(key, *told), key)
        .select(*series, *told, "date", *[v.alias(c) for c, v in prices.items()])
        .groupBy(*series, *told, "date")
        .agg(*[F.try_divide(F.sum(c), F.count(c)).alias(c) for c in prices])
    )
    own = Window.partitionBy(*series).orderBy("date")
    compared = competitive_features(daily.withColumn("price_lag_1d", F.lag("prices", 1).over(own)), sizes=observed.select("date"))
    if first_listing is not None:
        compared = with_first_listing(compared, first_listing)
    back = compared.drop("price_lag_1d", *told, CHEAPEST).repartition(key)
    past = temporal_features(back, windows, lags, series=series)
    out = cyclical_features(past.withColumn(CHEAPEST, cheapest()).join(listings, key))
    rest = [c for c in listings.columns if c not in (key, canonical, *LISTING)]
    market = ["price_vs_market_avg", "price_rank", CHEAPEST]
    first = [*LISTING, canonical, *rest, "date", *prices]
    made = [c for c in past.columns if c not in (*first, *market, key, first_listing)]
    flag = [] if first_listing is None else [first_listing]
    return out.select(*first, *made, *market, *[c for c in out.columns if c not in (*first, *made, *market, key, *flag)], *flag)
