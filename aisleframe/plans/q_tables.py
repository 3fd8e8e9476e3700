"""Queries on cleaning, contracts, marts and the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.functions.sampling import draw_order, first_k_per_group, sample_groups, sample_rows
from aisleframe.functions.text import contains_ci, encoder_text, listing_id, normalise_name
from aisleframe.operators import clean, contracts, features, market, marts, profile, warehouse
from aisleframe.panel import load, price_panel, raw_text, with_retailer
from aisleframe.plans.fragments import BASKETS, FACT, LATEST, LISTING_DAY, MARTS, PANEL
from aisleframe.plans.registry import query, rounded
from aisleframe.sources.raw import union_by_name


def fact_of(spark: SparkSession, sf: str) -> DataFrame:
    return marts.fact_price_daily(price_panel(spark, sf))


def dim_of(spark: SparkSession, sf: str) -> DataFrame:
    return marts.dim_product(price_panel(spark, sf))


def baskets_of(spark: SparkSession, sf: str) -> DataFrame:
    """One basket per first word of a product name, holding every such product."""
    return load(spark, sf, "part").select(
        F.split("p_name", " ")[0].alias("basket"), F.col("p_name").alias("canonical_name")
    ).distinct()


def store_names(spark: SparkSession, sf: str) -> list[str]:
    """Retailer names for a pivot's column list; the region table has a fixed handful of rows."""
    return [r["r_name"] for r in load(spark, sf, "region").select("r_name").orderBy("r_name").collect()]


# Cleaning and contracts -------------------------------------------------------------------------


def raw_of(spark: SparkSession, sf: str) -> DataFrame:
    """Panel as scraped text; rows of a single unit carry an unreadable price."""
    raw = raw_text(price_panel(spark, sf))
    single = F.col("`prices_(£)`") == F.col("`prices_unit_(£)`")
    return raw.withColumn("prices_(£)", F.when(single, F.lit("n/a")).otherwise(F.col("`prices_(£)`")))


@query(
    "clean_listings",
    f"""WITH {PANEL}
SELECT supermarket, CAST(CAST(prices AS DECIMAL(20,8)) AS DOUBLE) AS prices,
       CAST(CAST(prices_unit AS DECIMAL(20,8)) AS DOUBLE) AS prices_unit,
       'unit' AS unit, product_name, date, category,
       CASE WHEN own_brand THEN 'TRUE' ELSE 'False' END AS own_brand
FROM panel WHERE CAST(prices AS DECIMAL(20,8)) <> CAST(prices_unit AS DECIMAL(20,8))""",
)
def clean_listings(spark, sf):
    return clean.clean(raw_of(spark, sf))


@query(
    "contract_violations",
    f"""WITH {PANEL}, checks AS (
  SELECT count(*) FILTER (WHERE date IS NULL) AS date_present,
         count(*) FILTER (WHERE product_name IS NULL) AS product_name_present,
         count(*) FILTER (WHERE prices IS NULL) AS prices_present,
         count(*) FILTER (WHERE supermarket IS NULL) AS supermarket_present,
         count(*) FILTER (WHERE prices < 0) AS price_not_negative,
         count(*) FILTER (WHERE prices > 10000) AS price_not_above_limit,
         count(*) FILTER (WHERE supermarket NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) AS known_retailer
  FROM panel)
SELECT * FROM checks UNPIVOT (violations FOR rule IN (date_present, product_name_present, prices_present,
  supermarket_present, price_not_negative, price_not_above_limit, known_retailer))""",
)
def contract_violations(spark, sf):
    known = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    return contracts.raw_contract(known).violation_counts(price_panel(spark, sf))


@query(
    "contract_violation_rows",
    f"""WITH {PANEL}
SELECT product_name, supermarket, date, prices, 'price_not_above_limit' AS rule FROM panel WHERE prices > 10000""",
)
def contract_violation_rows(spark, sf):
    contract = contracts.raw_contract(store_names(spark, sf))
    return contract.violations(price_panel(spark, sf)).select("product_name", "supermarket", "date", "prices", "rule")


@query(
    "own_brand_parse",
    f"""WITH {PANEL}
SELECT supermarket, own_brand, count(*) AS n FROM panel GROUP BY 1, 2""",
)
def own_brand_parse(spark, sf):
    raw = clean.tidy_headers(raw_text(price_panel(spark, sf)))
    flags = raw.select(F.trim("supermarket").alias("supermarket"), clean.to_flag(F.col("own_brand")).alias("own_brand"))
    return flags.groupBy("supermarket", "own_brand").agg(F.count("*").alias("n"))


@query(
    "union_by_name",
    """SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS priority,
       NULL::INTEGER AS size FROM orders
UNION ALL SELECT p_partkey, CAST(p_retailprice AS DOUBLE), NULL, p_size FROM part
UNION ALL SELECT s_suppkey, CAST(s_acctbal AS DOUBLE), NULL, NULL FROM supplier""",
)
def union_query(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")
    )
    p = load(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("amount"), F.col("p_size").alias("size")
    )
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"))
    return union_by_name([o, p, s])


@query(
    "distinct_by_subset",
    f"""WITH {PANEL}
SELECT canonical_name, supermarket, product_name, prices FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_name, supermarket ORDER BY product_name, date, prices) AS rn
  FROM panel WHERE date = (SELECT max(date) FROM panel)) t WHERE rn = 1""",
)
def distinct_by_subset(spark, sf):
    order = [F.col("product_name").asc(), F.col("date").asc(), F.col("prices").asc()]
    newest = warehouse.on_latest_day(price_panel(spark, sf))
    return first_k_per_group(newest, ["canonical_name", "supermarket"], order, 1).select(
        "canonical_name", "supermarket", "product_name", "prices"
    )


@query(
    "distinct_rows",
    f"""WITH {PANEL} SELECT DISTINCT supermarket, category, brand, own_brand FROM panel""",
)
def distinct_rows(spark, sf):
    return price_panel(spark, sf).select("supermarket", "category", "brand", "own_brand").distinct()


@query(
    "quality_probes",
    f"""WITH {PANEL}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE prices = 0) AS zero_price,
       count(*) FILTER (WHERE prices_unit = 0 OR prices_unit IS NULL) AS zero_or_missing_unit_price,
       count(*) FILTER (WHERE (prices_unit = 0 OR prices_unit IS NULL) AND prices > 0) AS priced_without_unit_price
FROM panel""",
)
def quality_probes(spark, sf):
    return profile.quality_probes(price_panel(spark, sf))


@query(
    "null_profile",
    """SELECT * FROM (SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS doc_id,
  count(*) FILTER (WHERE d.lang IS NULL) AS lang, count(*) FILTER (WHERE l.quality IS NULL) AS quality,
  count(*) FILTER (WHERE l.toxic IS NULL) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
UNPIVOT (nulls FOR column_name IN (doc_id, lang, quality, toxic)) WHERE nulls > 0""",
)
def null_profile(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left")
    return profile.null_profile(docs)


@query(
    "row_loss",
    f"""WITH {PANEL}, s AS (SELECT count(*) AS rows_in, count(*) FILTER (WHERE prices <= 1000) AS rows_out FROM panel)
SELECT 'price_ceiling' AS stage, rows_in, rows_out, rows_out - rows_in AS row_delta,
       round(greatest(0.0, (rows_in - rows_out) / CAST(rows_in AS DOUBLE)), 6) AS loss_fraction,
       (rows_in - rows_out) / CAST(rows_in AS DOUBLE) > 0.2 AS warn FROM s""",
)
def row_loss(spark, sf):
    panel = price_panel(spark, sf)
    return rounded(profile.row_loss(panel, panel.filter("prices <= 1000"), F.lit("price_ceiling")))


@query(
    "column_summary",
    f"""WITH {PANEL}
SELECT count(prices_unit) AS n, round(avg(prices_unit), 4) AS mean, round(stddev_samp(prices_unit), 4) AS std,
       round(min(prices_unit), 4) AS min, round(max(prices_unit), 4) AS max,
       round(quantile_cont(prices_unit, 0.25), 4) AS p25, round(median(prices_unit), 4) AS p50,
       round(quantile_cont(prices_unit, 0.75), 4) AS p75 FROM panel""",
)
def column_summary(spark, sf):
    return rounded(profile.column_summary(price_panel(spark, sf), "prices_unit"), 4)


@query(
    "value_counts_null",
    """SELECT quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality""",
)
def value_counts_null(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left")
    return profile.value_counts(docs, "quality")


@query(
    "complete_case_fill",
    """SELECT d.doc_id, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic,
       l.quality IS NOT NULL AND l.toxic IS NOT NULL AS complete
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def complete_case_fill(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left")
    flagged = docs.withColumn("complete", F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return flagged.na.fill(0, subset=["quality", "toxic"])


# Names ------------------------------------------------------------------------------------------


@query(
    "name_normalise",
    r"""WITH lowered AS (
  SELECT l_orderkey, l_linenumber,
         regexp_replace(lower(p_name || ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'kg, ' || r_name || '''s Aldi!'),
           '\b\d+(\.\d+)?\s?(kg|g|ml|l|m|pack|pk|x\d+(\.\d+)?\s?(kg|g|ml|l)?|x)\b', '', 'g') AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
words AS (
  SELECT l_orderkey, l_linenumber, regexp_replace(t, '[^\p{L}\p{N}_\s]', '', 'g') AS t FROM lowered)
SELECT l_orderkey, l_linenumber, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t,
  'tesco', ''), 'asda', ''), 'sainsburys', ''), 'saintsburys', ''), 'morrisons', ''), 'aldi', ''),
  '\s+', ' ', 'g')) AS normalised_name FROM words""",
)
def name_normalise(spark, sf):
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    named = with_retailer(line.join(part, F.col("l_partkey") == F.col("p_partkey")), spark, sf, "l_suppkey")
    label = F.concat(
        "p_name", F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit("kg, "), "supermarket", F.lit("'s Aldi!")
    )
    return named.select("l_orderkey", "l_linenumber", normalise_name(label).alias("normalised_name"))


@query(
    "listing_ids",
    f"""WITH {PANEL}
SELECT DISTINCT supermarket || '|' || product_name AS listing_id, 'query: ' || canonical_name AS encoder_text FROM panel""",
)
def listing_ids(spark, sf):
    return price_panel(spark, sf).select(
        listing_id(F.col("supermarket"), F.col("product_name")).alias("listing_id"),
        encoder_text(F.col("canonical_name")).alias("encoder_text"),
    ).distinct()


@query(
    "text_contains",
    """SELECT doc_id, COALESCE(contains(lower(text), 'license'), false) AS mentions FROM documents""",
)
def text_contains(spark, sf):
    return load(spark, sf, "documents").select("doc_id", contains_ci(F.col("text"), "License").alias("mentions"))


# Marts ------------------------------------------------------------------------------------------


@query("dim_retailer", f"WITH {PANEL} SELECT DISTINCT supermarket AS retailer_name FROM panel")
def dim_retailer(spark, sf):
    return marts.dim_retailer(price_panel(spark, sf))


@query("dim_product", f"WITH {MARTS} SELECT * FROM dim")
def dim_product(spark, sf):
    return dim_of(spark, sf)


@query(
    "fact_price_daily",
    f"""WITH {PANEL}, {FACT}
SELECT canonical_name, supermarket, date, round(avg_price, 8) AS avg_price, min_price, max_price, n_listings FROM fact""",
)
def fact_price_daily(spark, sf):
    return rounded(fact_of(spark, sf), 8, ["avg_price"])


OVERVIEW_SQL = f"""WITH {MARTS},
overview AS (
  SELECT f.supermarket, count(DISTINCT f.canonical_name) AS portfolio_size,
         100.0 * count(*) FILTER (WHERE d.own_brand) / count(*) AS own_brand_pct,
         count(*) FILTER (WHERE d.own_brand) AS own_brand_count,
         count(*) FILTER (WHERE d.own_brand IS NOT TRUE) AS branded_count,
         min(f.avg_price) AS min_price, quantile_cont(f.avg_price, 0.25) AS price_p25,
         median(f.avg_price) AS price_median, quantile_cont(f.avg_price, 0.75) AS price_p75,
         max(f.avg_price) AS max_price
  FROM fact f JOIN dim d ON f.canonical_name = d.canonical_name GROUP BY f.supermarket)"""


@query(
    "market_overview",
    f"""{OVERVIEW_SQL}
SELECT supermarket, portfolio_size, round(own_brand_pct, 6) AS own_brand_pct, own_brand_count, branded_count,
       round(min_price, 6) AS min_price, round(price_p25, 6) AS price_p25, round(price_median, 6) AS price_median,
       round(price_p75, 6) AS price_p75, round(max_price, 6) AS max_price FROM overview""",
)
def market_overview(spark, sf):
    return rounded(warehouse.market_overview(fact_of(spark, sf), dim_of(spark, sf))).orderBy("supermarket")


@query(
    "tukey_fence",
    f"""{OVERVIEW_SQL},
whiskers AS (SELECT *, least(price_p75 + 1.5 * (price_p75 - price_p25), max_price) AS upper_fence FROM overview),
capped AS (SELECT *, ceil((SELECT max(upper_fence) FROM whiskers) / 5.0) * 5.0 AS axis_cap FROM whiskers)
SELECT supermarket, round(price_p25, 6) AS price_p25, round(price_median, 6) AS price_median,
       round(price_p75, 6) AS price_p75, round(max_price, 6) AS max_price, round(upper_fence, 6) AS upper_fence,
       round(axis_cap, 6) AS axis_cap, max_price > axis_cap AS beyond_cap,
       round(least(1.0, price_median / axis_cap), 6) AS median_share_of_axis FROM capped""",
)
def tukey_fence(spark, sf):
    out = warehouse.tukey_fences(warehouse.market_overview(fact_of(spark, sf), dim_of(spark, sf)))
    return rounded(out).drop("portfolio_size", "own_brand_pct", "own_brand_count", "branded_count", "min_price")


# Warehouse --------------------------------------------------------------------------------------


@query(
    "search_products",
    f"""WITH {MARTS}
SELECT canonical_name, category, own_brand, n_retailers, first_seen_date, last_seen_date FROM dim
WHERE lower(canonical_name) LIKE '%rod%' ORDER BY canonical_name LIMIT 20""",
)
def search_products(spark, sf):
    return warehouse.search_products(dim_of(spark, sf), "ROD")


@query(
    "type_ahead",
    f"""WITH {PANEL}
SELECT DISTINCT canonical_name FROM panel WHERE lower(canonical_name) LIKE '%ld%' ORDER BY 1 LIMIT 50""",
)
def type_ahead(spark, sf):
    return warehouse.type_ahead(price_panel(spark, sf), "LD")


@query(
    "keyword_basket",
    """SELECT DISTINCT p_name AS canonical_name FROM part
WHERE (lower(p_name) LIKE '%anvil%' OR lower(p_name) LIKE '%gear%' OR lower(p_name) LIKE '%blue%')
  AND NOT regexp_matches(p_name, '^[0-9]') ORDER BY 1 LIMIT 15""",
)
def keyword_basket(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_name").alias("canonical_name"))
    return warehouse.keyword_products(names, ["Anvil", "gear", "BLUE"])


FIRST_PRODUCT = "(SELECT min(canonical_name) FROM fact)"


@query(
    "product_history",
    f"""WITH {PANEL}, {FACT}
SELECT date, supermarket, round(avg_price, 8) AS avg_price, min_price, max_price, n_listings,
       max_price - min_price AS band_height
FROM fact WHERE canonical_name = {FIRST_PRODUCT}""",
)
def product_history(spark, sf):
    fact = fact_of(spark, sf)
    name = load(spark, sf, "part").agg(F.min("p_name")).scalar()
    return rounded(warehouse.history_chart(warehouse.product_history(fact, name)), 8, ["avg_price"])


@query(
    "product_histories",
    f"""WITH {PANEL}, {FACT},
asked AS (
  SELECT DISTINCT p_name AS canonical_name, 'EUROPE' AS store FROM part
  UNION ALL SELECT DISTINCT p_type, 'EUROPE' FROM part)
SELECT a.canonical_name, a.store AS requested_supermarket,
       CASE WHEN f.date IS NULL THEN 'not_found' ELSE 'ok' END AS status, f.date, f.supermarket,
       round(f.avg_price, 8) AS avg_price, f.min_price, f.max_price, f.n_listings
FROM asked a LEFT JOIN fact f ON f.canonical_name = a.canonical_name AND f.supermarket = a.store""",
)
def product_histories(spark, sf):
    part = load(spark, sf, "part")
    asked = part.select(F.col("p_name").alias("canonical_name")).union(part.select("p_type")).distinct()
    out = warehouse.product_histories(fact_of(spark, sf), asked.withColumn("supermarket", F.lit("EUROPE")))
    return rounded(out, 8, ["avg_price"])


@query(
    "history_with_forecast",
    f"""WITH {PANEL}, {FACT}, mine AS (SELECT * FROM fact WHERE canonical_name = {FIRST_PRODUCT}),
last_day AS (SELECT supermarket, max(date) AS date, max_by(avg_price, date) AS avg_price FROM mine GROUP BY 1)
SELECT date, supermarket, round(avg_price, 8) AS avg_price, max_price - min_price AS band_height,
       NULL::DOUBLE AS predicted_price FROM mine
UNION ALL SELECT date + 1, supermarket, NULL, NULL, round(avg_price, 8) FROM last_day""",
)
def history_with_forecast(spark, sf):
    name = load(spark, sf, "part").agg(F.min("p_name")).scalar()
    mine = warehouse.product_history(fact_of(spark, sf), name)
    naive = mine.groupBy("supermarket").agg(
        F.date_add(F.max("date"), 1).alias("date"), F.max_by("avg_price", "date").alias("predicted_price")
    )
    rows = warehouse.history_chart(mine, naive).select(
        "date", "supermarket", "avg_price", "band_height", "predicted_price"
    )
    return rounded(rows, 8, ["avg_price", "predicted_price"])


@query(
    "forecast_delta",
    f"""WITH {PANEL}, {FACT}, mine AS (SELECT * FROM fact WHERE canonical_name = {FIRST_PRODUCT}),
s AS (SELECT supermarket, avg(avg_price) AS predicted_price, max_by(avg_price, date) AS last_price FROM mine GROUP BY 1)
SELECT supermarket, round(predicted_price, 6) AS predicted_price, round(last_price, 6) AS last_price,
       round(predicted_price - last_price, 6) AS delta FROM s""",
)
def forecast_delta(spark, sf):
    """The long-run mean as the forecast, against the last price."""
    name = load(spark, sf, "part").agg(F.min("p_name")).scalar()
    mine = warehouse.product_history(fact_of(spark, sf), name)
    mean = mine.groupBy("supermarket").agg(F.avg("avg_price").alias("predicted_price"))
    return rounded(warehouse.forecast_delta(mine, mean))


@query(
    "product_stores",
    f"""WITH {PANEL}
SELECT DISTINCT canonical_name, supermarket FROM panel
WHERE canonical_name IN (SELECT canonical_name FROM panel WHERE prices > 50000)""",
)
def product_stores(spark, sf):
    panel = price_panel(spark, sf)
    return warehouse.product_stores(panel, panel.filter("prices > 50000").select("canonical_name"))


ESSENTIALS = "(SELECT canonical_name FROM baskets WHERE basket = (SELECT min(basket) FROM baskets))"


def essentials_of(spark: SparkSession, sf: str) -> DataFrame:
    baskets = baskets_of(spark, sf)
    return baskets.filter(F.col("basket") == baskets.agg(F.min("basket")).scalar()).select("canonical_name")


@query(
    "basket_cost",
    f"""WITH {PANEL}, {FACT}, {BASKETS}, {LATEST}
SELECT supermarket, round(sum(avg_price), 5) AS basket_cost, count(*) AS items_found
FROM latest WHERE canonical_name IN {ESSENTIALS} GROUP BY supermarket""",
)
def basket_cost(spark, sf):
    return rounded(warehouse.basket_cost(fact_of(spark, sf), essentials_of(spark, sf)), 5)


@query(
    "basket_items",
    f"""WITH {PANEL}, {FACT}, {BASKETS}, {LATEST}
SELECT canonical_name, supermarket, round(avg_price, 8) AS price
FROM latest WHERE canonical_name IN {ESSENTIALS}""",
)
def basket_items(spark, sf):
    return rounded(warehouse.basket_items(fact_of(spark, sf), essentials_of(spark, sf)), 8)


COVERAGE = """coverage AS (
  SELECT b.basket, l.supermarket, sum(l.avg_price) AS basket_cost, count(*) AS items_found,
         count(*) * 100.0 / max(s.n) AS coverage_pct, max(s.n) AS total_items
  FROM latest l JOIN baskets b ON l.canonical_name = b.canonical_name
  JOIN (SELECT basket, count(*) AS n FROM baskets GROUP BY 1) s ON s.basket = b.basket
  GROUP BY b.basket, l.supermarket)"""


@query(
    "basket_all_coverage",
    f"""WITH {PANEL}, {FACT}, {BASKETS}, {LATEST}, {COVERAGE}
SELECT basket, supermarket, round(basket_cost, 5) AS basket_cost, items_found, total_items,
       round(CAST(coverage_pct AS DOUBLE), 5) AS coverage_pct FROM coverage""",
)
def basket_all_coverage(spark, sf):
    return rounded(warehouse.basket_coverage(fact_of(spark, sf), baskets_of(spark, sf)).withColumn(
        "coverage_pct", F.col("coverage_pct").cast("double")), 5)


@query(
    "basket_ranking",
    f"""WITH {PANEL}, {FACT}, {BASKETS}, {LATEST}, {COVERAGE}
SELECT basket, round(avg(CAST(coverage_pct AS DOUBLE)), 5) AS average_coverage, round(min(basket_cost), 5) AS cheapest_cost,
       round(max(basket_cost), 5) AS dearest_cost,
       round(CASE WHEN max(basket_cost) > 0 THEN (max(basket_cost) - min(basket_cost)) / max(basket_cost) * 100
             ELSE 0 END, 5) AS savings_pct
FROM coverage GROUP BY basket""",
)
def basket_ranking(spark, sf):
    coverage = warehouse.basket_coverage(fact_of(spark, sf), baskets_of(spark, sf)).withColumn(
        "coverage_pct", F.col("coverage_pct").cast("double")
    )
    return rounded(warehouse.basket_ranking(coverage), 5)


STORE_COLUMNS = ",\n  ".join(
    f"""round(max(CASE WHEN supermarket = '{s}' THEN avg_price END), 8) AS "{s}\""""
    for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
)


@query(
    "basket_grid_pivot",
    f"""WITH {PANEL}, {FACT}, {BASKETS}, {LATEST}
SELECT canonical_name, {STORE_COLUMNS} FROM latest WHERE canonical_name IN (SELECT canonical_name FROM baskets)
GROUP BY canonical_name""",
)
def basket_grid_pivot(spark, sf):
    items = warehouse.basket_items(fact_of(spark, sf), baskets_of(spark, sf).select("canonical_name"))
    return rounded(warehouse.price_grid(items, store_names(spark, sf)), 8)


@query("date_bounds", f"WITH {PANEL} SELECT min(date) AS min_date, max(date) AS max_date FROM panel")
def date_bounds(spark, sf):
    return warehouse.date_bounds(price_panel(spark, sf))


@query(
    "median_by_retailer",
    f"""WITH {PANEL} SELECT supermarket, round(median(prices), 6) AS median_price FROM panel GROUP BY 1""",
)
def median_by_retailer(spark, sf):
    return rounded(warehouse.median_price(price_panel(spark, sf)))


@query(
    "portfolio_size",
    f"""WITH {PANEL} SELECT supermarket, count(DISTINCT product_name) AS n_products FROM panel GROUP BY 1""",
)
def portfolio_size(spark, sf):
    return warehouse.portfolio_size(price_panel(spark, sf))


@query(
    "own_brand_mix",
    f"""WITH {PANEL} SELECT supermarket, round(avg(CASE WHEN own_brand THEN 1.0 ELSE 0.0 END) * 100, 6) AS own_brand_pct,
  count(*) FILTER (WHERE own_brand) AS own_brand_count, count(*) FILTER (WHERE NOT own_brand) AS branded_count
FROM panel GROUP BY 1""",
)
def own_brand_mix(spark, sf):
    return rounded(warehouse.own_brand_mix(price_panel(spark, sf)))


@query(
    "daily_avg_price",
    f"""WITH {PANEL}
SELECT date, supermarket, round(avg(prices) + 1e-9, 6) AS avg_price FROM panel GROUP BY 1, 2
UNION ALL SELECT date, 'ALL', round(avg(prices) + 1e-9, 6) FROM panel GROUP BY 1""",
)
def daily_avg_price(spark, sf):
    return rounded(warehouse.daily_average(price_panel(spark, sf)), 6, nudge=True)


@query(
    "category_mix",
    f"""WITH {PANEL}, top AS (SELECT category FROM panel GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 10),
stores AS (SELECT supermarket, count(*) AS n FROM panel GROUP BY 1)
SELECT s.supermarket, t.category, round(count(p.category) / CAST(max(s.n) AS DOUBLE), 6) AS share
FROM stores s CROSS JOIN top t LEFT JOIN panel p ON p.supermarket = s.supermarket AND p.category = t.category
GROUP BY 1, 2""",
)
def category_mix(spark, sf):
    return rounded(warehouse.category_mix(price_panel(spark, sf)))


@query(
    "top_unit_price",
    f"""WITH {PANEL} SELECT product_name, supermarket, date, prices_unit FROM panel
ORDER BY prices_unit DESC, product_name, supermarket, date LIMIT 10""",
)
def top_unit_price(spark, sf):
    return (
        price_panel(spark, sf)
        .select("product_name", "supermarket", "date", "prices_unit")
        .orderBy(F.desc("prices_unit"), "product_name", "supermarket", "date")
        .limit(10)
    )


# Samples ----------------------------------------------------------------------------------------


@query(
    "seeded_sample",
    """SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber
LIMIT 1000""",
)
def seeded_sample(spark, sf):
    return sample_rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 1000, ["l_orderkey", "l_linenumber"])


@query(
    "group_sample",
    f"""WITH {PANEL}, names AS (SELECT DISTINCT product_name FROM panel),
kept AS (
  SELECT product_name FROM (
    SELECT product_name, row_number() OVER (ORDER BY md5('42|' || product_name), product_name) AS rn FROM names) t
  WHERE rn <= (SELECT count(*) // 10 FROM names))
SELECT supermarket, product_name, date, prices FROM panel WHERE product_name IN (SELECT product_name FROM kept)""",
)
def group_sample(spark, sf):
    rows = price_panel(spark, sf).select("supermarket", "product_name", "date", "prices")
    return sample_groups(rows, "product_name", 10)


@query(
    "stratified_basket",
    f"""WITH {PANEL}, pairs AS (SELECT DISTINCT category, supermarket, canonical_name FROM panel),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, supermarket
    ORDER BY md5('42|' || category || '|' || supermarket || '|' || canonical_name)) AS rn FROM pairs) t WHERE rn <= 5),
names AS (SELECT DISTINCT category, canonical_name FROM picked WHERE NOT regexp_matches(canonical_name, '^[0-9]'))
SELECT category, canonical_name FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY canonical_name) AS rn FROM names) t WHERE rn <= 20""",
)
def stratified_basket(spark, sf):
    pairs = price_panel(spark, sf).select("category", "supermarket", "canonical_name").distinct()
    order = draw_order("category", "supermarket", "canonical_name")
    picked = first_k_per_group(pairs, ["category", "supermarket"], [order], 5)
    names = picked.select("category", "canonical_name").distinct().filter(~F.col("canonical_name").rlike("^[0-9]"))
    return first_k_per_group(names, ["category"], [F.col("canonical_name")], 20)


@query(
    "product_counts_shared",
    f"""WITH {PANEL}
SELECT canonical_name FROM (SELECT DISTINCT canonical_name FROM panel WHERE supermarket = 'ASIA') a
INTERSECT SELECT DISTINCT canonical_name FROM panel WHERE supermarket = 'EUROPE'""",
)
def product_counts_shared(spark, sf):
    return market.shared_products(price_panel(spark, sf), "ASIA", "EUROPE")


@query(
    "listing_day",
    f"""WITH {PANEL}, {LISTING_DAY}
SELECT supermarket, product_name, canonical_name, category, brand, own_brand, date,
       round(prices, 8) AS prices, round(prices_unit, 8) AS prices_unit FROM listing""",
)
def listing_day(spark, sf):
    return rounded(features.listing_day(price_panel(spark, sf)), 8)
