"""SQL building blocks of the expected results."""

from __future__ import annotations

PANEL = """panel AS (
  SELECT r_name AS supermarket,
         p_name || ' #' || CAST(l_partkey AS VARCHAR) AS product_name,
         p_name AS canonical_name, p_type AS category, p_brand AS brand,
         p_size <= 25 AS own_brand, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS prices, l_extendedprice AS prices_unit
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

FACT = """fact AS (
  SELECT canonical_name, supermarket, date, avg(prices) AS avg_price, min(prices) AS min_price,
         max(prices) AS max_price, count(*) AS n_listings
  FROM panel GROUP BY canonical_name, supermarket, date)"""


def mode_of(column: str, alias: str) -> str:
    return f"""{alias} AS (
  SELECT canonical_name, {column} FROM (
    SELECT canonical_name, {column},
           row_number() OVER (PARTITION BY canonical_name ORDER BY count(*) DESC, {column}) AS rn
    FROM panel GROUP BY canonical_name, {column}) t WHERE rn = 1)"""


DIM = f"""{mode_of('category', 'mode_category')},
{mode_of('own_brand', 'mode_own')},
dim AS (
  SELECT p.canonical_name, min(c.category) AS category, bool_or(o.own_brand) AS own_brand,
         min(p.date) AS first_seen_date, max(p.date) AS last_seen_date,
         count(DISTINCT p.supermarket) AS n_retailers
  FROM panel p JOIN mode_category c ON p.canonical_name = c.canonical_name
  JOIN mode_own o ON p.canonical_name = o.canonical_name
  GROUP BY p.canonical_name)"""

MARTS = f"{PANEL},\n{FACT},\n{DIM}"

BASKETS = """baskets AS (
  SELECT DISTINCT split_part(p_name, ' ', 1) AS basket, p_name AS canonical_name FROM part)"""

LATEST = """latest AS (SELECT * FROM fact WHERE date = (SELECT max(date) FROM fact))"""

LISTING_DAY = """listing AS (
  SELECT supermarket, product_name, min(canonical_name) AS canonical_name, min(category) AS category,
         min(brand) AS brand, bool_and(own_brand) AS own_brand, date,
         avg(prices) AS prices, avg(prices_unit) AS prices_unit
  FROM panel GROUP BY supermarket, product_name, date)"""


def temporal(windows: list[int], lags: list[int], source: str = "listing", name: str = "temporal") -> str:
    w = "PARTITION BY supermarket, product_name ORDER BY date"
    cols = []
    for n in windows:
        frame = f"OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols += [
            f"avg(prices) {frame} AS price_rol_mean_{n}d",
            f"stddev_samp(prices) {frame} AS price_rol_std_{n}d",
            f"max(prices) {frame} AS price_rol_max_{n}d",
            f"min(prices) {frame} AS price_rol_min_{n}d",
        ]
    cols += [f"lag(prices, {k}) OVER ({w}) AS price_lag_{k}d" for k in lags]
    cols += [
        f"lag(prices, 1) OVER ({w}) - lag(prices, 2) OVER ({w}) AS price_diff_1d",
        f"CAST(date - lag(date, 1) OVER ({w}) AS DOUBLE) AS days_since_last_obs",
    ]
    return f"{name} AS (\n  SELECT *, " + ",\n         ".join(cols) + f"\n  FROM {source})"


# Leave-one-out by direct comparison with the other rows of the product and day.
COMPETITIVE = """market AS (
  SELECT *, sum(price_lag_1d) OVER (PARTITION BY canonical_name, date) AS s_all,
         count(price_lag_1d) OVER (PARTITION BY canonical_name, date) AS n_all,
         rank() OVER (PARTITION BY canonical_name, date ORDER BY price_lag_1d ASC NULLS LAST) AS r_all
  FROM temporal),
competitive AS (
  SELECT * EXCLUDE (s_all, n_all, r_all),
         CASE WHEN price_lag_1d IS NOT NULL AND n_all > 1
              THEN price_lag_1d - (s_all - price_lag_1d) / (n_all - 1) END AS price_vs_market_avg,
         CASE WHEN price_lag_1d IS NOT NULL AND n_all > 1 THEN CAST(r_all AS DOUBLE) END AS price_rank,
         CASE WHEN price_lag_1d IS NOT NULL AND n_all > 1 AND r_all = 1 THEN 1 ELSE 0 END AS is_cheapest_in_market
  FROM market)"""

CYCLES = {
    "day_of_week": ("isodow(date) - 1", 7),
    "day_of_month": ("day(date)", 31),
    "week_of_year": ("week(date)", 52),
}


def cyclical(digits: int = 6) -> str:
    return ",\n  ".join(
        f"round({fn}(2.0 * pi() * ({part}) / {length}.0), {digits}) AS {name}_{fn}"
        for name, (part, length) in CYCLES.items()
        for fn in ("sin", "cos")
    )


FEATURES = f"{PANEL},\n{LISTING_DAY},\n{temporal([7, 14, 30], [1, 7])},\n{COMPETITIVE}"

MONTHLY = """monthly AS (
  SELECT supermarket, brand AS canonical_name, CAST(date_trunc('month', date) AS DATE) AS date, prices FROM panel)"""


def filled(source: str) -> str:
    """Dense forward-filled series of a (supermarket, canonical_name, date, prices) relation."""
    return f"""daily AS (
  SELECT supermarket, canonical_name, date, avg(prices) AS price FROM {source} GROUP BY 1, 2, 3),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS date_idx FROM (SELECT DISTINCT date FROM daily) t),
series AS (SELECT DISTINCT supermarket, canonical_name FROM daily),
filled AS (
  SELECT s.supermarket, s.canonical_name, d.date_idx,
         last_value(p.price IGNORE NULLS) OVER (PARTITION BY s.supermarket, s.canonical_name ORDER BY d.date_idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
  FROM series s CROSS JOIN days d
  LEFT JOIN daily p ON p.supermarket = s.supermarket AND p.canonical_name = s.canonical_name AND p.date = d.date)"""


def lag_analysis(source: str, max_lag: int) -> str:
    return f"""{filled(source)},
eligible AS (
  SELECT supermarket, canonical_name FROM filled GROUP BY 1, 2
  HAVING count(price) = (SELECT count(*) FROM days) AND var_samp(price) > 1e-6),
ok AS (
  SELECT f.* FROM filled f JOIN eligible e ON f.supermarket = e.supermarket AND f.canonical_name = e.canonical_name),
corrs AS (
  SELECT l.supermarket AS leader, f.supermarket AS follower, l.canonical_name, lags.lag,
         CASE WHEN stddev_pop(l.price) * stddev_pop(f.price) > 0
              THEN covar_pop(l.price, f.price) / (stddev_pop(l.price) * stddev_pop(f.price)) END AS corr
  FROM ok l CROSS JOIN (SELECT unnest(range(-{max_lag}, {max_lag + 1})) AS lag) lags
  JOIN ok f ON f.canonical_name = l.canonical_name AND f.supermarket <> l.supermarket
           AND f.date_idx = l.date_idx - lags.lag
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)"""


def best(min_correlation: float) -> str:
    return f"""best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY leader, follower, canonical_name ORDER BY abs(corr) DESC, lag) AS rn
    FROM corrs WHERE corr IS NOT NULL) t
  WHERE rn = 1 AND abs(corr) > {min_correlation})"""


def leadership(max_lag: int, min_correlation: float, source: str = "monthly") -> str:
    return f"""{lag_analysis(source, max_lag)},
{best(min_correlation)},
leadership AS (
  SELECT leader, follower, CAST(median(lag) AS DOUBLE) AS median_lag_days, count(*) AS n_products_analyzed
  FROM best GROUP BY 1, 2)"""


# A negative lag means the row's leader moves first.
EDGES = """once AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY least(leader, follower), greatest(leader, follower)
                                 ORDER BY leader, follower) AS rn
    FROM leadership WHERE median_lag_days <> 0) t WHERE rn = 1),
edges AS (
  SELECT CASE WHEN median_lag_days < 0 THEN leader ELSE follower END AS leader,
         CASE WHEN median_lag_days < 0 THEN follower ELSE leader END AS follower,
         abs(median_lag_days) AS lag_days, n_products_analyzed AS n_products
  FROM once)"""

DISPERSION = """per_product AS (
  SELECT canonical_name, date, avg(prices) AS m, stddev_samp(prices) AS s FROM panel GROUP BY 1, 2),
dispersion AS (
  SELECT date, avg(CASE WHEN m > 0 THEN s / m ELSE 0 END) AS dispersion FROM per_product GROUP BY date)"""
