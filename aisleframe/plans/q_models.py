"""Queries on forecasting, scoring, anomalies and explanations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.operators import anomaly, artifacts, explain, forecast, leadership, market, scoring, warehouse
from aisleframe.operators.encoding import NON_FEATURES
from aisleframe.operators.evaluation import bootstrap_mae
from aisleframe.panel import monthly_brand_panel
from aisleframe.plans.fragments import (
    DISPERSION,
    FACT,
    FEATURES,
    LATEST,
    LISTING_DAY,
    MONTHLY,
    PANEL,
    temporal,
)
from aisleframe.plans.fragments import leadership as leadership_sql
from aisleframe.plans.q_features import ANSWERS, LAG_COLUMNS, REQUESTS, ROLLING_COLUMNS, features_of, requests_of, split_of
from aisleframe.plans.q_tables import OVERVIEW_SQL, baskets_of, dim_of, fact_of
from aisleframe.plans.registry import query, rounded
from aisleframe.session import settle

# Leaves, least rows and draws as published; fewer trees with a larger step, so that a run of all queries stays short.
PARAMS = forecast.TreeParams(n_trees=60, learning_rate=0.2)
EXCLUDE = [*NON_FEATURES, "brand"]


def model_rows(spark: SparkSession, sf: str) -> forecast.ModelRows:
    """The rows and columns of the feature table that training reads many times, cut from their lineage."""
    return forecast.gather(features_of(spark, sf), exclude=EXCLUDE)


def trained(data: forecast.ModelRows) -> tuple[forecast.PriceModel, DataFrame]:
    train, test = data.split()
    return forecast.train(data.spec, train, PARAMS), test


# Rows that can be trained on: every number a model input needs is there.
COMPLETE = f"""{FEATURES},
complete AS (
  SELECT * FROM competitive WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*ROLLING_COLUMNS, *LAG_COLUMNS, "price_vs_market_avg", "price_rank"])}),
test AS (SELECT * FROM complete WHERE date > (SELECT max(date) FROM listing) - 7)"""


@query(
    "gbt_forecast",
    f"""WITH {COMPLETE}
SELECT supermarket, product_name, date, round(prices, 6) AS prices, round(price_lag_1d, 6) AS naive_last_price,
       round(price_rol_mean_7d + 1e-9, 5) AS rolling_mean_7, true AS has_forecast FROM test""",
)
def gbt_forecast(spark, sf):
    """Every test row with the baselines' forecasts and whether the model made one."""
    model, test = trained(model_rows(spark, sf))
    scored = forecast.score_test(model, test).withColumn("has_forecast", F.col("model").isNotNull() & ~F.isnan("model"))
    out = rounded(scored.drop("model"), 6, ["prices", "naive_last_price"])
    return rounded(out, 5, ["rolling_mean_7"], nudge=True)


@query("gbt_metrics")
def gbt_metrics(spark, sf):
    """Scores of the model beside the baselines; the same from run to run."""
    model, test = trained(model_rows(spark, sf))
    return forecast.metrics_table(forecast.score_test(model, test))


@query(
    "gbt_early_stopping",
    f"""WITH {COMPLETE} SELECT count(*) AS n_test_rows, true AS stopped_at_best, true AS ended_early FROM test""",
)
def gbt_early_stopping(spark, sf):
    """Training listings decide when to stop: the model ends at their best tree, ahead of the last one allowed."""
    data = model_rows(spark, sf)
    train, test = data.split()
    params = replace(PARAMS, n_trees=200, validation_share=0.1, patience=10)
    model = forecast.train(data.spec, train, params)
    errors = model.booster.held_errors
    best = max(errors.index(min(errors)), 1) if errors else 0
    return model.predict(test, "model").agg(
        F.count("model").alias("n_test_rows"),
        F.lit(model.n_trees == best).alias("stopped_at_best"),
        F.lit(model.n_trees < params.n_trees).alias("ended_early"),
    )


@query(
    "whatif_scoring",
    f"""WITH {PANEL}, {LISTING_DAY}, {temporal([7], [1])}, {REQUESTS}, {ANSWERS},
told AS (
  SELECT *, CASE WHEN price_override < 0 THEN 'invalid_override'
    WHEN as_of_date NOT BETWEEN (SELECT min(date) FROM listing) AND (SELECT max(date) FROM listing) THEN 'out_of_range'
    WHEN resolved_from_date IS NOT NULL THEN 'ok' WHEN known_pair THEN 'no_history_yet' ELSE 'unknown_product'
    END AS status FROM answers)
SELECT request_id, canonical_name, supermarket, as_of_date, status, resolved_from_date,
       status = 'ok' AS has_price, status = 'ok' AND price_override IS NOT NULL AS price_override_applied,
       status = 'ok' AND COALESCE(price_override, price_lag_1d) IS NULL AS lag_unresolved
FROM told""",
)
def whatif_scoring(spark, sf):
    """What every request comes to: status, the day resolved, whether a price was predicted, whether its lag was missing."""
    # Requests are answered by the first listing of a pair and day: those rows are stored beside the ones for training.
    first = "first_listing"
    features = features_of(spark, sf, first)
    data = forecast.gather(features, exclude=[*EXCLUDE, first], also=F.col(first), carried=["canonical_name", first])
    model, _ = trained(data)
    out = scoring.score_requests(model, requests_of(spark, sf), data.rows.filter(first))
    return out.select(
        "request_id",
        "canonical_name",
        "supermarket",
        "as_of_date",
        "status",
        "resolved_from_date",
        F.col("predicted_price").isNotNull().alias("has_price"),
        "price_override_applied",
        F.coalesce(F.array_contains("unresolved_features", "price_lag_1d"), F.lit(False)).alias("lag_unresolved"),
    )


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    _, test = split_of(spark, sf)
    return bootstrap_mae(test, ["price_lag_1d", "price_rol_mean_7d"], ["supermarket", "product_name"])


@query(
    "listing_errors",
    f"""WITH {PANEL}, {LISTING_DAY}, {temporal([7], [1])}
SELECT supermarket, product_name, CAST(count(*) AS DOUBLE) AS n_rows, round(sum(abs(prices - price_lag_1d)) + 1e-9, 5) AS price_lag_1d,
       round(sum(abs(prices - price_rol_mean_7d)) + 1e-9, 5) AS price_rol_mean_7d
FROM temporal WHERE price_lag_1d IS NOT NULL AND price_rol_mean_7d IS NOT NULL
  AND date <= (SELECT max(date) FROM listing) - 7 GROUP BY 1, 2""",
)
def listing_errors(spark, sf):
    from aisleframe.operators.evaluation import listing_errors as errors

    train, _ = split_of(spark, sf)
    return rounded(errors(train, ["price_lag_1d", "price_rol_mean_7d"], ["supermarket", "product_name"]), 5, nudge=True)


def anomaly_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the feature table that the forest and its result read, cut from their lineage."""
    return settle(features_of(spark, sf).select(*anomaly.KEYS, *anomaly.FEATURES))


@query("anomaly_flags")
def anomaly_flags(spark, sf):
    flagged = anomaly.detect_anomalies(anomaly_inputs(spark, sf))
    return flagged.select("supermarket", "product_name", "date", "prices", "is_anomaly")


@query("anomaly_share_filled")
def anomaly_share_filled(spark, sf):
    """The variant that scores every row, missing features as zero."""
    return anomaly.anomaly_share(anomaly.detect_anomalies(anomaly_inputs(spark, sf), seed=123, fill_missing=True))


def contributions_of(spark: SparkSession, sf: str, n_samples: int | None = 8000) -> DataFrame:
    """Contributions of ``n_samples`` complete rows, or of every one for None."""
    data = model_rows(spark, sf)
    model, _ = trained(data)
    keys = ["supermarket", "product_name", "date"]
    rows = data.spec.encode(data.rows, keys)
    return explain.contributions(model, rows, keys, n_samples)


@query("shapley_contributions")
def shapley_contributions(spark, sf):
    """Contributions of every complete row."""
    return contributions_of(spark, sf, None)


SAMPLED = f"""WITH {COMPLETE},
sampled AS (
  SELECT concat_ws('|', supermarket, product_name, CAST(date AS VARCHAR)) AS sample_id FROM complete
  ORDER BY md5(concat_ws('|', '42', supermarket, product_name, CAST(date AS VARCHAR))), sample_id LIMIT 8000)"""


@query("shapley_additivity", f"{SAMPLED} SELECT sample_id, true AS adds_up FROM sampled")
def shapley_additivity(spark, sf):
    """Base value and contributions of every sampled row make up the model's own prediction."""
    both = explain.additivity(contributions_of(spark, sf))
    close = F.abs(F.col("rebuilt") - F.col("prediction")) <= 1e-6 * F.greatest(F.abs("prediction"), F.lit(1.0))
    return both.select("sample_id", close.alias("adds_up"))


@query("global_importance")
def global_importance(spark, sf):
    """Mean absolute contributions over every complete row."""
    return explain.global_importance(contributions_of(spark, sf, None))


@query("grouped_importance")
def grouped_importance(spark, sf):
    return explain.grouped_importance(contributions_of(spark, sf))


@query("local_top10", f"{SAMPLED} SELECT sample_id, CAST(10 AS BIGINT) AS n_shown, true AS strongest FROM sampled")
def local_top10(spark, sf):
    """Ten contributions of every sampled row; no other one of the row is stronger."""
    contribs = settle(contributions_of(spark, sf))
    shown = explain.local_top(contribs).groupBy("sample_id").agg(
        F.count("*").alias("n_shown"), F.min(F.abs("contribution")).alias("_least"), F.collect_set("feature").alias("_names")
    )
    rest = contribs.join(shown, "sample_id").filter(~F.array_contains("_names", F.col("feature")))
    beaten = rest.groupBy("sample_id").agg(F.max(F.abs("contribution")).alias("_next"))
    return shown.join(beaten, "sample_id", "left").select(
        "sample_id", "n_shown", (F.col("_least") >= F.coalesce("_next", F.lit(0.0))).alias("strongest")
    )


@query(
    "page_json",
    f"""WITH {PANEL}, {FACT}, {LATEST}, baskets AS (
  SELECT DISTINCT split_part(p_name, ' ', 1) AS basket, p_name AS canonical_name FROM part),
cost AS (
  SELECT b.basket, l.supermarket, sum(l.avg_price) AS c, count(*) AS n
  FROM latest l JOIN baskets b ON b.canonical_name = l.canonical_name GROUP BY 1, 2)
SELECT basket, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_items,
       round(sum(c), 4) AS total_cost FROM cost GROUP BY basket""",
)
def page_json(spark, sf):
    """Nested basket documents, read back from their JSON text and summed up."""
    docs = artifacts.basket_documents(fact_of(spark, sf), baskets_of(spark, sf))
    text = docs.select("basket", F.to_json(F.struct("total_items", "rows", "items")).alias("body"))
    schema = "total_items long, rows array<struct<supermarket string, basket_cost double, items_found long>>, items array<struct<price double>>"
    back = text.select("basket", F.from_json("body", schema).alias("d"))
    return rounded(
        back.select(
            "basket",
            F.size("d.rows").cast("long").alias("n_rows"),
            F.size("d.items").cast("long").alias("n_items"),
            F.aggregate("d.rows", F.lit(0.0), lambda a, r: a + r["basket_cost"]).alias("total_cost"),
        ),
        4,
    ).filter("n_rows > 0")


def read_back(document: DataFrame) -> DataFrame:
    """A document of one row, written as JSON text and read again by its own schema."""
    schema = document.schema.simpleString()
    text = document.select(F.to_json(F.struct(*document.columns)).alias("body"))
    return text.select(F.from_json("body", schema).alias("d")).select("d.*")


@query(
    "overview_page",
    f"""{OVERVIEW_SQL}
SELECT supermarket, portfolio_size, round(own_brand_pct, 6) AS own_brand_pct, own_brand_count, branded_count,
       round(min_price, 6) AS min_price, round(price_p25, 6) AS price_p25, round(price_median, 6) AS price_median,
       round(price_p75, 6) AS price_p75, round(max_price, 6) AS max_price FROM overview""",
)
def overview_page(spark, sf):
    """The retailers of the overview page, taken from its JSON text."""
    page = artifacts.overview_document(warehouse.market_overview(fact_of(spark, sf), dim_of(spark, sf)))
    return rounded(read_back(page).select(F.explode("supermarkets").alias("s")).select("s.*"))


@query(
    "dynamics_page",
    f"""WITH {PANEL}, {MONTHLY}, {DISPERSION.replace("FROM panel", "FROM monthly")}, {leadership_sql(3, 0.15)},
kept AS (SELECT * FROM leadership WHERE median_lag_days <> 0),
fast AS (SELECT * FROM kept ORDER BY abs(median_lag_days), leader, follower LIMIT 1)
SELECT (SELECT count(*) FROM dispersion) AS n_days, (SELECT round(sum(dispersion), 4) FROM dispersion) AS dispersion_sum,
       (SELECT CAST(min(date) AS VARCHAR) FROM dispersion) AS first_day,
       (SELECT round(max_by(dispersion, date), 6) FROM dispersion) AS latest_dispersion,
       (SELECT round(avg(dispersion), 6) FROM dispersion) AS avg_dispersion, (SELECT count(*) FROM kept) AS n_pairs,
       (SELECT sum(median_lag_days) FROM kept) AS lag_sum,
       (SELECT CAST(sum(n_products_analyzed) AS BIGINT) FROM kept) AS n_products,
       (SELECT leader FROM kept GROUP BY leader ORDER BY count(*) DESC, leader LIMIT 1) AS top_leader,
       (SELECT leader || ' ' || follower || ' ' || CAST(median_lag_days AS VARCHAR) FROM fast) AS fastest""",
)
def dynamics_page(spark, sf):
    """Sums and summaries of the dynamics page, taken from its JSON text."""
    panel = settle(monthly_brand_panel(spark, sf))
    pairs = leadership.price_leadership(panel, max_lag=3)
    page = read_back(artifacts.dynamics_document(market.dispersion(panel), pairs))
    fast = F.col("fastest_follower")

    def total(rows: str, column: str, start) -> F.Column:
        return F.aggregate(rows, F.lit(start), lambda a, r: a + r[column].cast("double" if isinstance(start, float) else "int"))

    return page.select(
        F.size("dispersion").cast("long").alias("n_days"),
        F.round(total("dispersion", "dispersion", 0.0), 4).alias("dispersion_sum"),
        F.col("dispersion")[0]["date"].alias("first_day"),
        F.round("latest_dispersion", 6).alias("latest_dispersion"),
        F.round("avg_dispersion", 6).alias("avg_dispersion"),
        F.size("leadership").cast("long").alias("n_pairs"),
        total("leadership", "median_lag_days", 0.0).alias("lag_sum"),
        total("leadership", "n_products_analyzed", 0).cast("long").alias("n_products"),
        "top_leader",
        F.concat_ws(" ", fast["leader"], fast["follower"], fast["median_lag_days"].cast("string")).alias("fastest"),
    )
