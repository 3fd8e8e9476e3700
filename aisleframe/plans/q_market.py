"""Queries on market structure and price leadership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.functions.text import title_label
from aisleframe.operators import leadership as lead
from aisleframe.operators import market, series, warehouse
from aisleframe.operators.explain import feature_group, feature_label
from aisleframe.panel import monthly_brand_panel, price_panel
from aisleframe.plans.fragments import (
    DISPERSION,
    EDGES,
    MARTS,
    MONTHLY,
    PANEL,
    best,
    filled,
    lag_analysis,
    leadership,
)
from aisleframe.plans.q_tables import dim_of, fact_of, store_names
from aisleframe.plans.registry import query, rounded

MAX_LAG = 3
MIN_CORR = 0.15


@query(
    "hhi",
    f"""WITH {PANEL}, c AS (SELECT category, supermarket, count(*) AS n FROM panel GROUP BY 1, 2),
s AS (SELECT category, n / CAST(sum(n) OVER (PARTITION BY category) AS DOUBLE) * 100 AS share FROM c),
h AS (SELECT category, CAST(round_even(sum(share * share), 0) AS INTEGER) AS hhi FROM s GROUP BY 1)
SELECT category, hhi, CASE WHEN hhi <= 1500 THEN 'Competitive' WHEN hhi <= 2500 THEN 'Moderate'
       ELSE 'Highly Concentrated' END AS concentration FROM h""",
)
def hhi(spark, sf):
    return market.hhi(price_panel(spark, sf))


@query("dispersion", f"WITH {PANEL}, {DISPERSION} SELECT date, round(dispersion, 6) AS dispersion FROM dispersion")
def dispersion(spark, sf):
    return rounded(market.dispersion(price_panel(spark, sf)))


@query(
    "dispersion_rolling7",
    f"""WITH {PANEL}, {DISPERSION}
SELECT date, round(dispersion, 6) AS dispersion,
  round(CASE WHEN count(dispersion) OVER w = 7 THEN avg(dispersion) OVER w END, 6) AS dispersion_7d
FROM dispersion WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def dispersion_rolling7(spark, sf):
    return rounded(market.rolling_mean(market.dispersion(price_panel(spark, sf)), "dispersion"))


@query(
    "dispersion_summary",
    f"""WITH {PANEL}, {DISPERSION},
s AS (SELECT max_by(dispersion, date) AS l, avg(dispersion) AS a, min(dispersion) AS lo, max(dispersion) AS hi FROM dispersion)
SELECT round(l, 6) AS latest_dispersion, round(a, 6) AS avg_dispersion, round(lo, 6) AS min_dispersion,
       round(hi, 6) AS max_dispersion,
       round(CASE WHEN hi > lo THEN (1 - (l - lo) / (hi - lo)) * 100 ELSE 100 END, 6) AS competitiveness_index FROM s""",
)
def dispersion_summary(spark, sf):
    return rounded(market.dispersion_summary(market.dispersion(price_panel(spark, sf))))


@query(
    "multi_retailer_products",
    f"""WITH {PANEL}
SELECT product_name, count(DISTINCT supermarket) AS n_retailers FROM panel GROUP BY 1 HAVING count(DISTINCT supermarket) > 1""",
)
def multi_retailer_products(spark, sf):
    return market.multi_retailer_products(price_panel(spark, sf), "product_name")


SPREAD = """comparable AS (
  SELECT * FROM panel WHERE product_name IN (
    SELECT product_name FROM panel GROUP BY 1 HAVING count(DISTINCT supermarket) > 1)),
per_store AS (
  SELECT product_name, supermarket, avg(prices) AS price FROM comparable
  WHERE date = (SELECT max(date) FROM comparable) GROUP BY 1, 2),
spread AS (
  SELECT product_name, min(price) AS min_price, max(price) AS max_price, max(price) - min(price) AS price_spread,
         arg_min(supermarket, {'p': price, 's': supermarket}) AS cheapest_supermarket
  FROM per_store GROUP BY 1)"""


def comparable_of(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the listings that more than one retailer sells under the same name."""
    panel = price_panel(spark, sf)
    names = market.multi_retailer_products(panel, "product_name").select("product_name")
    return panel.join(names, "product_name", "left_semi")


def spread_of(spark: SparkSession, sf: str) -> DataFrame:
    return market.price_spread(warehouse.on_latest_day(comparable_of(spark, sf)), "product_name")


@query(
    "price_spread",
    f"""WITH {PANEL}, {SPREAD}
SELECT product_name, round(min_price, 8) AS min_price, round(max_price, 8) AS max_price,
       round(price_spread, 8) AS price_spread, cheapest_supermarket
FROM spread ORDER BY spread.price_spread DESC, product_name LIMIT 10""",
)
def price_spread(spark, sf):
    return rounded(spread_of(spark, sf).orderBy(F.desc("price_spread"), "product_name").limit(10), 8)


@query(
    "product_price_spread",
    f"""WITH {PANEL}, per_store AS (
  SELECT canonical_name, supermarket, avg(prices) AS price FROM panel GROUP BY 1, 2)
SELECT canonical_name, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price,
       round(max(price) - min(price), 6) AS price_spread,
       arg_min(supermarket, {{'p': price, 's': supermarket}}) AS cheapest_supermarket
FROM per_store GROUP BY 1""",
)
def product_price_spread(spark, sf):
    return rounded(market.price_spread(price_panel(spark, sf)))


@query(
    "cheapest_counts",
    f"""WITH {PANEL}, {SPREAD} SELECT cheapest_supermarket, count(*) AS n_products FROM spread GROUP BY 1""",
)
def cheapest_counts(spark, sf):
    return market.cheapest_counts(spread_of(spark, sf))


@query(
    "volatility_top",
    f"""WITH {PANEL}, v AS (
  SELECT product_name, stddev_samp(prices) AS volatility FROM panel GROUP BY 1 HAVING stddev_samp(prices) IS NOT NULL)
(SELECT product_name, round(volatility, 6) AS volatility, 'most' AS side FROM v ORDER BY v.volatility DESC, product_name LIMIT 10)
UNION ALL
(SELECT product_name, round(volatility, 6), 'least' FROM v ORDER BY v.volatility, product_name LIMIT 10)""",
)
def volatility_top(spark, sf):
    vol = market.volatility(price_panel(spark, sf), "product_name")
    return rounded(market.volatility_extremes(vol, 10, "product_name"))


# Series -----------------------------------------------------------------------------------------


def filled_of(spark: SparkSession, sf: str) -> DataFrame:
    return series.forward_filled(series.daily_series(monthly_brand_panel(spark, sf)))


@query(
    "ffill_panel",
    f"""WITH {PANEL}, src AS (SELECT supermarket, category AS canonical_name, date, prices FROM panel), {filled("src")}
SELECT supermarket, canonical_name, CAST(date_idx AS INTEGER) AS date_idx, round(price + 1e-9, 5) AS price FROM filled""",
)
def ffill_panel(spark, sf):
    rows = price_panel(spark, sf).select("supermarket", F.col("category").alias("canonical_name"), "date", "prices")
    return rounded(series.forward_filled(series.daily_series(rows)).drop("n_dates"), 5, nudge=True)


@query(
    "seasonal_decompose",
    f"""WITH {PANEL},
daily AS (SELECT supermarket, canonical_name, date, avg(prices) AS price FROM panel GROUP BY 1, 2, 3),
days AS (SELECT canonical_name, date, row_number() OVER (PARTITION BY canonical_name ORDER BY date) AS date_idx
         FROM (SELECT DISTINCT canonical_name, date FROM daily) t),
grid AS (SELECT s.supermarket, d.canonical_name, d.date, d.date_idx
         FROM (SELECT DISTINCT supermarket, canonical_name FROM daily) s JOIN days d ON s.canonical_name = d.canonical_name),
full_rows AS (
  SELECT g.supermarket, g.canonical_name, g.date_idx,
         last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.supermarket, g.canonical_name ORDER BY g.date_idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observed
  FROM grid g LEFT JOIN daily p ON p.supermarket = g.supermarket AND p.canonical_name = g.canonical_name AND p.date = g.date),
seen AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY supermarket, canonical_name) AS len
  FROM full_rows WHERE observed IS NOT NULL WINDOW w AS (PARTITION BY supermarket, canonical_name ORDER BY date_idx)),
trended AS (
  SELECT *, (rn - 1) % 7 AS phase, CASE WHEN count(*) OVER w = 7 THEN avg(observed) OVER w END AS trend
  FROM seen WHERE len >= 14
  WINDOW w AS (PARTITION BY supermarket, canonical_name ORDER BY date_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
phases AS (SELECT supermarket, canonical_name, phase, avg(observed - trend) AS m FROM trended GROUP BY 1, 2, 3),
overall AS (SELECT supermarket, canonical_name, avg(m) AS m FROM phases GROUP BY 1, 2)
SELECT t.supermarket, t.canonical_name, CAST(t.date_idx AS INTEGER) AS date_idx, round(t.observed + 1e-9, 5) AS observed,
       round(t.trend + 1e-9, 4) AS trend, round(p.m - o.m, 4) AS seasonal, round(t.observed - t.trend - (p.m - o.m), 4) AS resid
FROM trended t
JOIN phases p ON p.supermarket = t.supermarket AND p.canonical_name = t.canonical_name AND p.phase = t.phase
JOIN overall o ON o.supermarket = t.supermarket AND o.canonical_name = t.canonical_name""",
)
def seasonal_decompose(spark, sf):
    out = series.seasonal_decompose(series.daily_series(price_panel(spark, sf)))
    out = rounded(rounded(out, 5, ["observed"], nudge=True), 4, ["trend"], nudge=True)
    return rounded(out, 4, ["seasonal", "resid"])


# Leadership -------------------------------------------------------------------------------------


@query(
    "series_eligibility",
    f"""WITH {PANEL}, {MONTHLY}, {filled("monthly")}
SELECT supermarket, canonical_name, count(price) AS n_prices, CAST((SELECT count(*) FROM days) AS INTEGER) AS n_dates,
       round(var_samp(price), 4) AS variance,
       count(price) = (SELECT count(*) FROM days) AND COALESCE(var_samp(price) > 1e-6, false) AS eligible
FROM filled GROUP BY 1, 2""",
)
def series_eligibility(spark, sf):
    return rounded(lead.series_eligibility(filled_of(spark, sf)), 4)


def correlations_of(spark: SparkSession, sf: str, max_lag: int = MAX_LAG) -> DataFrame:
    return lead.lag_correlations(lead.store_pairs(lead.series_arrays(filled_of(spark, sf))), max_lag)


@query(
    "lagged_corr_profile",
    f"""WITH {PANEL}, {MONTHLY}, {lag_analysis("monthly", 14)}
SELECT leader, follower, canonical_name, CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr FROM corrs""",
)
def lagged_corr_profile(spark, sf):
    return rounded(correlations_of(spark, sf, 14))


@query(
    "best_lag",
    f"""WITH {PANEL}, {MONTHLY}, {lag_analysis("monthly", MAX_LAG)}, {best(MIN_CORR)}
SELECT leader, follower, canonical_name, CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr FROM best""",
)
def best_lag(spark, sf):
    return rounded(lead.best_lags(correlations_of(spark, sf), MIN_CORR))


@query(
    "common_date_corr",
    f"""WITH {PANEL},
daily AS (SELECT supermarket, brand AS canonical_name, date, avg(prices) AS price FROM panel GROUP BY 1, 2, 3),
common AS (
  SELECT a.supermarket AS leader, b.supermarket AS follower, a.canonical_name, a.price AS x, b.price AS y,
         row_number() OVER (PARTITION BY a.supermarket, b.supermarket, a.canonical_name ORDER BY a.date) AS t
  FROM daily a JOIN daily b ON a.canonical_name = b.canonical_name AND a.date = b.date AND a.supermarket <> b.supermarket),
sizes AS (SELECT leader, follower, canonical_name, count(*) AS n FROM common GROUP BY 1, 2, 3),
paired AS (
  SELECT l.leader, l.follower, l.canonical_name, g.lag, s.n, l.x, r.y
  FROM common l CROSS JOIN (SELECT unnest(range(-14, 15)) AS lag) g
  JOIN common r ON r.leader = l.leader AND r.follower = l.follower AND r.canonical_name = l.canonical_name AND r.t = l.t - g.lag
  JOIN sizes s ON s.leader = l.leader AND s.follower = l.follower AND s.canonical_name = l.canonical_name
  WHERE s.n - abs(g.lag) >= 2)
SELECT leader, follower, canonical_name, CAST(lag AS INTEGER) AS lag,
       round(CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS corr
FROM paired GROUP BY leader, follower, canonical_name, lag""",
)
def common_date_corr(spark, sf):
    """Brands by day: every retailer's series has other gaps, so lags run over the dates two of them share."""
    rows = price_panel(spark, sf).select("supermarket", F.col("brand").alias("canonical_name"), "date", "prices")
    daily = rows.groupBy("supermarket", "canonical_name", "date").agg(F.avg("prices").alias("price"))
    return rounded(lead.lag_correlations(lead.common_date_pairs(daily), 14), 6, ["corr"])


def leadership_of(spark: SparkSession, sf: str, **options) -> DataFrame:
    return lead.price_leadership(
        monthly_brand_panel(spark, sf), **{"max_lag": MAX_LAG, "min_correlation": MIN_CORR, **options}
    )


@query(
    "price_leadership",
    f"""WITH {PANEL}, {MONTHLY}, {leadership(MAX_LAG, MIN_CORR)}
SELECT * FROM leadership WHERE median_lag_days <> 0""",
)
def price_leadership(spark, sf):
    return leadership_of(spark, sf)


@query(
    "price_leadership_daily",
    f"""WITH {PANEL}, src AS (SELECT supermarket, category AS canonical_name, date, prices FROM panel),
{leadership(7, 0.0, "src")}
SELECT leader, follower, median_lag_days, n_products_analyzed FROM leadership WHERE median_lag_days <> 0""",
)
def price_leadership_daily(spark, sf):
    rows = price_panel(spark, sf).select("supermarket", F.col("category").alias("canonical_name"), "date", "prices")
    return lead.price_leadership(rows, max_lag=7, min_correlation=0.0)


@query(
    "leadership_all_lags",
    f"""WITH {PANEL}, {MONTHLY}, {leadership(MAX_LAG, 0.2)} SELECT * FROM leadership""",
)
def leadership_all_lags(spark, sf):
    return leadership_of(
        spark, sf, min_correlation=0.2, min_stores=None, products_per_pair=100, drop_zero=False
    ).orderBy(F.desc("median_lag_days"), "leader", "follower")


@query(
    "leadership_edges",
    f"""WITH {PANEL}, {MONTHLY}, {leadership(MAX_LAG, MIN_CORR)}, {EDGES}
SELECT *, round(CASE WHEN max(lag_days) OVER () > min(lag_days) OVER ()
  THEN 1 - (lag_days - min(lag_days) OVER ()) / (max(lag_days) OVER () - min(lag_days) OVER ()) ELSE 1.0 END, 6) AS strength
FROM edges""",
)
def leadership_edges(spark, sf):
    return rounded(lead.leadership_edges(leadership_of(spark, sf)), 6, ["strength"])


@query(
    "leadership_matrix",
    f"""WITH {PANEL}, {MONTHLY}, {leadership(MAX_LAG, MIN_CORR)}, {EDGES}
SELECT leader, {", ".join(f'''max(CASE WHEN follower = '{s}' THEN lag_days END) AS "{s}"'''
                         for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
FROM edges GROUP BY leader""",
)
def leadership_matrix(spark, sf):
    return lead.leadership_matrix(lead.leadership_edges(leadership_of(spark, sf)), store_names(spark, sf))


@query(
    "leadership_summary",
    f"""WITH {PANEL}, {MONTHLY}, {leadership(MAX_LAG, MIN_CORR)},
kept AS (SELECT * FROM leadership WHERE median_lag_days <> 0),
fast AS (SELECT * FROM kept ORDER BY abs(median_lag_days), leader, follower LIMIT 1)
SELECT (SELECT leader FROM kept GROUP BY leader ORDER BY count(*) DESC, leader LIMIT 1) AS top_leader,
       (SELECT leader FROM fast) AS fastest_leader, (SELECT follower FROM fast) AS fastest_follower,
       (SELECT median_lag_days FROM fast) AS fastest_lag_days,
       CAST((SELECT sum(n_products_analyzed) FROM kept) AS BIGINT) AS total_products""",
)
def leadership_summary(spark, sf):
    return lead.leadership_summary(leadership_of(spark, sf))


@query(
    "headline_metrics",
    f"""WITH {MARTS}
SELECT (SELECT count(*) FROM panel) AS total_records, (SELECT count(*) FROM dim) AS canonical_products,
       (SELECT count(*) FROM fact) AS fact_rows""",
)
def headline_metrics(spark, sf):
    facts = fact_of(spark, sf).agg(F.count("*").alias("fact_rows"))
    return warehouse.headline_metrics(price_panel(spark, sf), dim_of(spark, sf), facts)


@query(
    "feature_labels",
    f"""WITH {PANEL}, names AS (
  SELECT DISTINCT 'supermarket_' || supermarket AS feature FROM panel
  UNION SELECT DISTINCT 'category_' || category FROM panel
  UNION SELECT DISTINCT 'brand_' || replace(brand, '#', '_') FROM panel)
SELECT feature, CASE WHEN feature LIKE 'supermarket%' THEN 'Retailer: ' || substr(feature, 13)
                     WHEN feature LIKE 'category%'
                       THEN 'Category: ' || upper(substr(feature, 10, 1)) || replace(substr(feature, 11), '_', ' ')
                     ELSE 'Brand ' || replace(substr(feature, 7), '_', ' ') END AS label,
       CASE WHEN feature LIKE 'supermarket%' THEN 'retailer' WHEN feature LIKE 'category%' THEN 'category'
            ELSE feature END AS family,
       CASE WHEN feature LIKE 'brand%' THEN 'Brand ' || replace(substr(feature, 7), '_', ' ') END AS plain
FROM names""",
)
def feature_labels(spark, sf):
    panel = price_panel(spark, sf)
    names = (
        panel.select(F.concat(F.lit("supermarket_"), "supermarket").alias("feature"))
        .union(panel.select(F.concat(F.lit("category_"), "category")))
        .union(panel.select(F.concat(F.lit("brand_"), F.replace("brand", F.lit("#"), F.lit("_")))))
        .distinct()
    )
    f = F.col("feature")
    return names.select(
        "feature",
        feature_label(f).alias("label"),
        feature_group(f).alias("family"),
        F.when(f.startswith("brand"), title_label(f)).alias("plain"),
    )
