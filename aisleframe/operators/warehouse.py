"""Queries over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.quantiles import exact_quantiles
from aisleframe.functions.text import contains_any_ci, contains_ci, starts_with_digit
from aisleframe.session import settle

QUARTILES = {"price_p25": 0.25, "price_median": 0.5, "price_p75": 0.75}


def market_overview(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Portfolio, own-brand mix and five-number price summary per retailer.

    Shares and prices are weighted by fact rows, so a product seen on more
    days counts more.
    """
    # Four narrow columns, read by the summary and by every pass of the quantiles.
    joined = settle(
        fact.join(dim.select("canonical_name", "own_brand"), "canonical_name").select(
            "supermarket", "canonical_name", "own_brand", "avg_price"
        )
    )
    own = F.when(F.col("own_brand"), 1).otherwise(0)
    summary = joined.groupBy("supermarket").agg(
        F.count_distinct("canonical_name").alias("portfolio_size"),
        (F.avg(own.cast("double")) * 100).alias("own_brand_pct"),
        F.sum(own).alias("own_brand_count"),
        F.sum(1 - own).alias("branded_count"),
        F.min("avg_price").cast("double").alias("min_price"),
        F.max("avg_price").cast("double").alias("max_price"),
    )
    return summary.join(exact_quantiles(joined, ["supermarket"], "avg_price", QUARTILES), "supermarket").select(
        "supermarket",
        "portfolio_size",
        "own_brand_pct",
        "own_brand_count",
        "branded_count",
        "min_price",
        *QUARTILES,
        "max_price",
    )


def tukey_fences(overview: DataFrame, axis_step: float = 5.0) -> DataFrame:
    """Upper whisker, the largest whisker rounded up to the axis step, and who exceeds it."""
    fence = F.col("price_p75") + F.lit(1.5) * (F.col("price_p75") - F.col("price_p25"))
    whiskers = overview.withColumn("upper_fence", F.least(fence, F.col("max_price")))
    # One row per retailer: a window over all of them is tiny, and the overview is made once.
    widest = F.max("upper_fence").over(Window.partitionBy(F.lit(0)))
    return whiskers.withColumn("axis_cap", (F.ceil(widest / axis_step) * axis_step).cast("double")).withColumns(
        {
            "beyond_cap": F.col("max_price") > F.col("axis_cap"),
            "median_share_of_axis": F.least(F.lit(1.0), F.col("price_median") / F.col("axis_cap")),
        }
    )


def search_products(dim: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Products whose name holds the text, any case; % and _ are plain characters."""
    hits = dim.filter(contains_ci(F.col("canonical_name"), query)).select(
        "canonical_name", "category", "own_brand", "n_retailers", "first_seen_date", "last_seen_date"
    )
    hits = hits.orderBy("canonical_name")
    return hits.limit(limit) if limit is not None else hits


def type_ahead(names: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Distinct names for a selector; fewer than two characters match nothing."""
    if len(text.strip()) < 2:
        return names.select("canonical_name").limit(0)
    hits = names.filter(contains_ci(F.col("canonical_name"), text.strip())).select("canonical_name").distinct()
    return hits.orderBy("canonical_name").limit(limit)


def keyword_products(names: DataFrame, keywords: list[str], max_items: int = 15) -> DataFrame:
    """Names that hold any keyword and do not start with a digit."""
    name = F.col("canonical_name")
    hits = names.select("canonical_name").distinct().filter(contains_any_ci(name, keywords) & ~starts_with_digit(name))
    return hits.orderBy("canonical_name").limit(max_items)


def product_history(fact: DataFrame, canonical_name: str, supermarket: str | None = None) -> DataFrame:
    rows = fact.filter(F.col("canonical_name") == canonical_name)
    if supermarket is not None:
        rows = rows.filter(F.col("supermarket") == supermarket)
    return rows.select("date", "supermarket", "avg_price", "min_price", "max_price", "n_listings").orderBy(
        "date", "supermarket"
    )


def product_histories(fact: DataFrame, requests: DataFrame) -> DataFrame:
    """History of many (canonical_name, supermarket) requests; null supermarket asks for all.

    A request without any row comes back once with status ``not_found``.
    """
    wanted = requests.select("canonical_name", F.col("supermarket").alias("_store")).distinct()
    one_store = wanted.filter(F.col("_store").isNotNull()).withColumn("supermarket", F.col("_store"))
    any_store = wanted.filter(F.col("_store").isNull())
    by_store = one_store.join(fact, ["canonical_name", "supermarket"], "left")
    by_name = any_store.join(fact, "canonical_name", "left")
    both = by_store.unionByName(by_name.select(*by_store.columns))
    return both.select(
        "canonical_name",
        F.col("_store").alias("requested_supermarket"),
        F.when(F.col("date").isNull(), "not_found").otherwise("ok").alias("status"),
        "date",
        F.when(F.col("date").isNotNull(), F.col("supermarket")).alias("supermarket"),
        "avg_price",
        "min_price",
        "max_price",
        "n_listings",
    )


def history_chart(history: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Band height per point, with predicted points appended to the observed ones."""
    rows = history.withColumn("band_height", F.col("max_price") - F.col("min_price"))
    if predictions is not None:
        rows = rows.unionByName(predictions, allowMissingColumns=True)
    return rows


def forecast_delta(history: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted price less the last observed one, per retailer."""
    last = history.groupBy("supermarket").agg(F.max_by("avg_price", "date").alias("last_price"))
    return predictions.join(last, "supermarket").withColumn("delta", F.col("predicted_price") - F.col("last_price"))


def on_latest_day(fact: DataFrame) -> DataFrame:
    """Rows of the newest day; the date is a scalar subquery the scan can use."""
    latest = fact.agg(F.max("date").alias("d")).scalar()
    return fact.filter(F.col("date") == latest)


def _basket_rows(fact: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    wanted = items.select(*keys, "canonical_name").distinct()
    return on_latest_day(fact).join(wanted, "canonical_name")


def basket_cost(fact: DataFrame, items: DataFrame) -> DataFrame:
    """Cost and items found per retailer on the newest day; what is absent is not counted."""
    return (
        _basket_rows(fact, items, [])
        .groupBy("supermarket")
        .agg(F.sum("avg_price").cast("double").alias("basket_cost"), F.count("*").alias("items_found"))
        .orderBy("supermarket")
    )


def basket_items(fact: DataFrame, items: DataFrame) -> DataFrame:
    return (
        _basket_rows(fact, items, [])
        .select("canonical_name", "supermarket", F.col("avg_price").cast("double").alias("price"))
        .orderBy("canonical_name", "supermarket")
    )


def basket_coverage(fact: DataFrame, baskets: DataFrame) -> DataFrame:
    """All baskets at once: cost, items found and share of the list found."""
    sizes = baskets.groupBy("basket").agg(F.count("*").alias("total_items"))
    cost = (
        _basket_rows(fact, baskets, ["basket"])
        .groupBy("basket", "supermarket")
        .agg(F.sum("avg_price").cast("double").alias("basket_cost"), F.count("*").alias("items_found"))
    )
    return cost.join(sizes, "basket").withColumn(
        "coverage_pct", F.col("items_found") * 100.0 / F.col("total_items")
    )


def basket_ranking(coverage: DataFrame) -> DataFrame:
    """Baskets by mean coverage, with the saving of the cheapest over the dearest retailer."""
    low, high = F.min("basket_cost"), F.max("basket_cost")
    return (
        coverage.groupBy("basket")
        .agg(
            F.avg("coverage_pct").alias("average_coverage"),
            low.alias("cheapest_cost"),
            high.alias("dearest_cost"),
            F.when(high > 0, (high - low) / high * 100).otherwise(F.lit(0.0)).alias("savings_pct"),
        )
        .orderBy(F.desc("average_coverage"), "basket")
    )


def price_grid(rows: DataFrame, stores: list[str], price: str = "price") -> DataFrame:
    """Products by retailers; several prices of a cell are averaged, an empty cell is null."""
    return rows.groupBy("canonical_name").pivot("supermarket", stores).agg(F.avg(price))


def product_stores(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Retailers that stock each of the chosen products."""
    return rows.join(products, "canonical_name", "left_semi").select("canonical_name", "supermarket").distinct()


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def headline_metrics(canonical: DataFrame, dim: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row: total records, canonical products and, when given, the model metrics."""
    one = F.lit(1).alias("_one")
    out = canonical.agg(F.count("*").alias("total_records"), one).join(
        dim.agg(F.count("*").alias("canonical_products"), one), "_one"
    )
    if metrics is not None:
        out = out.join(metrics.withColumn("_one", F.lit(1)), "_one", "left")
    return out.drop("_one")


def own_brand_mix(rows: DataFrame) -> DataFrame:
    flag = F.coalesce(F.col("own_brand").cast("int"), F.lit(0))
    return rows.groupBy("supermarket").agg(
        (F.avg(flag.cast("double")) * 100).alias("own_brand_pct"),
        F.sum(flag).alias("own_brand_count"),
        F.sum(1 - flag).alias("branded_count"),
    )


def portfolio_size(rows: DataFrame, name: str = "product_name") -> DataFrame:
    return rows.groupBy("supermarket").agg(F.count_distinct(name).alias("n_products"))


def median_price(rows: DataFrame) -> DataFrame:
    return exact_quantiles(rows, ["supermarket"], "prices", {"median_price": 0.5}).orderBy("median_price")


def daily_average(rows: DataFrame) -> DataFrame:
    """Mean price per day, per retailer and over all retailers (supermarket ``ALL``).

    Both come from one pass: the retailer level is summed up to the day level.
    """
    per_store = rows.groupBy("date", "supermarket").agg(
        F.sum("prices").alias("_s"), F.count("prices").alias("_n")
    )
    overall = per_store.groupBy("date").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    both = per_store.unionByName(overall.withColumn("supermarket", F.lit("ALL")))
    return both.select("date", "supermarket", F.try_divide("_s", "_n").alias("avg_price"))


def category_mix(rows: DataFrame, top: int = 10) -> DataFrame:
    """Share of each retailer's rows in the largest categories; a missing pair is 0."""
    counts = rows.groupBy("supermarket", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy("supermarket").agg(F.sum("n").alias("store_total"))
    largest = (
        counts.groupBy("category").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "category").limit(top)
    )
    # The category list is at most ``top`` long, so it travels as one array value.
    names = largest.agg(F.collect_list("category").alias("c")).scalar()
    grid = totals.select("supermarket", "store_total", F.explode(names).alias("category"))
    return grid.join(counts, ["supermarket", "category"], "left").select(
        "supermarket", "category", (F.coalesce("n", F.lit(0)) / F.col("store_total")).alias("share")
    )
