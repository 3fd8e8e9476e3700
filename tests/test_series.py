import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.operators import leadership, series
from aisleframe.functions.quantiles import exact_quantiles

from conftest import day

SCHEMA = "canonical_name string, supermarket string, date date, prices double"


def test_forward_fill_keeps_leading_gap(spark):
    rows = [("a", "S", day(1), 1.0), ("a", "S", day(3), 2.0), ("b", "S", day(0), 9.0), ("b", "S", day(4), 8.0)]
    out = series.forward_filled(series.daily_series(spark.createDataFrame(rows, SCHEMA)))
    got = [r.price for r in out.filter("canonical_name = 'a'").orderBy("date_idx").collect()]
    assert got == [None, 1.0, 2.0, 2.0]
    assert {r.n_dates for r in out.collect()} == {4}


def delayed_market(days=80, products=20, lag=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for p in range(products):
        price, path = 10.0, []
        for _ in range(days + lag):
            price = max(1.0, price + rng.uniform(-1, 1))
            path.append(price)
        for d in range(days):
            rows.append((f"p{p}", "Leader", day(d), path[d + lag]))
            rows.append((f"p{p}", "Follower", day(d), path[d]))
            rows.append((f"p{p}", "Noise", day(d), rng.uniform(1, 10)))
    return rows


def test_known_delay_is_found(spark):
    out = leadership.price_leadership(spark.createDataFrame(delayed_market(), SCHEMA))
    got = {(r.leader, r.follower): (r.median_lag_days, r.n_products_analyzed) for r in out.collect()}
    assert got["Leader", "Follower"] == (-3.0, 20) and got["Follower", "Leader"] == (3.0, 20)
    edges = leadership.leadership_edges(out.filter("leader <> 'Noise' and follower <> 'Noise'"))
    assert [(r.leader, r.follower, r.lag_days) for r in edges.collect()] == [("Leader", "Follower", 3.0)]
    page = leadership.leadership_edges(out.filter("leader <> 'Noise' and follower <> 'Noise'"), "page")
    assert [(r.leader, r.follower) for r in page.collect()] == [("Follower", "Leader")]


@pytest.mark.parametrize("seed", [1, 2])
def test_leadership_equals_nested_loops(spark, seed):
    rng = random.Random(seed)
    rows, stores, products, days, max_lag = [], "ABC", 6, 30, 4
    for p in range(products):
        for s in stores:
            price = 5.0
            for d in range(days):
                price = max(0.5, price + rng.uniform(-0.5, 0.5))
                if d == 0 or rng.random() < 0.8:
                    rows.append((f"p{p}", s, day(d), round(price, 2)))
    got = {
        (r.leader, r.follower): (r.median_lag_days, r.n_products_analyzed)
        for r in leadership.price_leadership(spark.createDataFrame(rows, SCHEMA), max_lag=max_lag).collect()
    }
    grid = {}
    for p, s, d, v in rows:
        grid.setdefault((s, p), {})[d] = v
    full = {}
    for key, points in grid.items():
        last, vals = None, []
        for d in range(days):
            last = points.get(day(d), last)
            vals.append(last)
        full[key] = np.array(vals)
    expect = {}
    for a in stores:
        for b in stores:
            if a == b:
                continue
            lags = []
            for p in range(products):
                x, y = full[a, f"p{p}"], full[b, f"p{p}"]
                cors = []
                for lag in range(-max_lag, max_lag + 1):
                    xs, ys = (x[lag:], y[: days - lag]) if lag >= 0 else (x[:lag], y[-lag:])
                    cors.append(np.corrcoef(xs, ys)[0, 1])
                best = int(np.argmax(np.abs(cors)))
                if abs(cors[best]) > 0.15:
                    lags.append(best - max_lag)
            if lags and np.median(lags) != 0:
                expect[a, b] = (float(np.median(lags)), len(lags))
    assert got == expect


def test_constant_prices_lead_nobody(spark):
    flat = [("p", s, day(d), 1.95) for s in "ABC" for d in range(92)]
    assert leadership.price_leadership(spark.createDataFrame(flat, SCHEMA)).count() == 0
    step = [("p", s, day(d), 1.95 if d < 40 + 2 * i else 1.96) for i, s in enumerate("ABC") for d in range(92)]
    assert leadership.price_leadership(spark.createDataFrame(step, SCHEMA)).count() > 0


def test_no_common_product_gives_an_empty_table(spark):
    out = leadership.price_leadership(spark.createDataFrame([("p", "A", day(0), 1.0)], SCHEMA))
    assert out.columns == ["leader", "follower", "median_lag_days", "n_products_analyzed"] and out.count() == 0


def test_seasonal_parts_add_up_and_find_the_week(spark):
    week = [0, 1, 2, 3, -3, -2, -1]
    rows = [("p", "A", day(d), 10 + 0.1 * d + week[d % 7]) for d in range(56)] + [("q", "A", day(d), 1.0) for d in range(10)]
    out = series.seasonal_decompose(series.daily_series(spark.createDataFrame(rows, SCHEMA))).orderBy("date_idx").collect()
    assert len(out) == 56
    assert [r.seasonal for r in out[:7]] == pytest.approx(week, abs=1e-6)
    assert out[0].trend is None and out[3].trend == pytest.approx(10.3)
    assert all(abs(r.resid) < 1e-6 for r in out if r.resid is not None)


@pytest.mark.parametrize("n", [1, 2, 101, 1000])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([3.0, 7.25, rng.uniform(0, 100), -rng.uniform(0, 5)]) for _ in range(n)]
    rows = [("g", v) for v in values] + [("h", 1.0), ("h", None)]
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
    for name, p in probs.items():
        assert got["g"][name] == pytest.approx(float(np.quantile(values, p)))
        assert got["h"][name] == 1.0
    whole = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], 0.5)))


def test_quantile_plan_holds_no_collecting_percentile(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert "percentile" not in exact_quantiles(df, [], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
