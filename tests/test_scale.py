"""Sources read once, categories of any width, gappy series, and ranks over many partitions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleframe.functions import levels, quantiles
from aisleframe.functions.ranking import with_rank
from aisleframe.operators import artifacts, encoding, leadership, market, warehouse
from aisleframe.panel import monthly_brand_panel
from aisleframe.plans import q_models
from aisleframe.plans.q_tables import dim_of, fact_of

from conftest import day


@pytest.fixture
def scans(monkeypatch):
    """Scans of lineitem in every plan that is settled, and in plans given to it."""
    seen = []

    def count(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(text.count("l_shipdate#") and sum("Relation [" in x and "l_extendedprice" in x for x in text.splitlines()))
        return df

    for module in (artifacts, leadership, warehouse, q_models):
        plain = module.settle
        monkeypatch.setattr(module, "settle", lambda df, plain=plain: plain(count(df)))
    return seen, count


def test_leadership_and_dynamics_page_read_the_source_once(spark, sf, scans):
    seen, count = scans
    count(leadership.price_leadership(monthly_brand_panel(spark, sf), max_lag=3))
    assert sum(seen) == 1
    seen.clear()
    count(q_models.dynamics_page(spark, sf))
    assert sum(seen) == 1


def test_overview_reads_the_source_at_most_twice(spark, sf, scans):
    seen, count = scans
    count(warehouse.market_overview(fact_of(spark, sf), dim_of(spark, sf)))
    assert 1 <= sum(seen) <= 3 and seen[-1] == 0


# Series with gaps of their own


def test_lags_over_common_dates(spark):
    rng = random.Random(8)
    series = {}
    for store, share in (("A", 0.7), ("B", 0.5), ("C", 0.06)):
        series[store] = {d: round(rng.uniform(1, 9), 2) for d in range(2 if store == "A" else 9, 80) if rng.random() < share}
    rows = [(s, "milk", day(d), p) for s, x in series.items() for d, p in x.items()] + [("A", "milk", day(300), None), ("D", "milk", day(5), 2.0)]
    daily = spark.createDataFrame(rows, "supermarket string, canonical_name string, date date, price double")
    got = {(r.leader, r.follower, r.lag): r.corr for r in leadership.lag_correlations(leadership.common_date_pairs(daily), 5).collect()}
    for a in "ABC":
        for b in "ABC":
            if a == b:
                continue
            common = sorted(series[a].keys() & series[b].keys())
            x = pd.Series([series[a][d] for d in common])
            y = pd.Series([series[b][d] for d in common])
            for lag in range(-5, 6):
                both = pd.concat([x, y.shift(lag)], axis=1).dropna()
                if len(both) < 2:
                    assert (a, b, lag) not in got
                    continue
                want = both[0].corr(both[1])
                assert got[a, b, lag] == (None if np.isnan(want) else pytest.approx(want, abs=1e-9))
    assert not any("D" in k[:2] for k in got)
    assert len(common) and len({k[:2] for k in got}) >= 2


# Categories


def test_hundred_thousand_levels_in_a_plan_of_constant_width(spark):
    wide = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("wide"), (F.col("id") % 3).cast("string").alias("few"))
    levels = encoding.level_table(wide, ["few", "wide"])
    assert levels.count() == 2 + 99_999
    ask = spark.createDataFrame([("v0", "0"), ("v1", "2"), ("v99999", None), ("new", "1"), (None, None)], "wide string, few string")
    out = encoding.encode_sparse(ask, levels, ["few", "wide"])
    order = sorted(f"v{k}" for k in range(100_000))
    place = {v: 1 + k for k, v in enumerate(order)}
    got = {(r.wide, r.few): r.active for r in out.collect()}
    assert got == {("v0", "0"): [], ("v1", "2"): [1, place["v1"]], ("v99999", None): [place["v99999"]], ("new", "1"): [0], (None, None): []}
    few = encoding.encode_sparse(ask, levels.filter("level < '2'"), ["few", "wide"])
    assert len(out._jdf.queryExecution().analyzed().toString()) < 1.1 * len(few._jdf.queryExecution().analyzed().toString())


def test_sparse_positions_equal_the_dense_columns(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["b", "a", "c", None]), rng.choice(["x", "y", None]), rng.choice([True, False])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, one string, two string, three boolean")
    spec = encoding.fit_spec(df, ["k"])
    dense = {r[0]: [j for j, v in enumerate(r[2:]) if v] for r in spec.encode(df, ["k"]).collect()}
    names = list(spec.levels)
    sparse = encoding.encode_sparse(df, encoding.level_table(df, names), names)
    assert {r.k: list(r.active) for r in sparse.collect()} == dense
    empty = encoding.encode_sparse(df, encoding.level_table(df.limit(0), names), names)
    assert {len(r.active) for r in empty.collect()} == {0}


def test_ranks_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r["rank"] for r in with_rank(df, [F.desc("v"), F.col("k")], within="g").collect()}
        whole = {r.k: r.nr for r in with_rank(df, [F.desc("v"), F.col("k")], name="nr").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in order] == list(range(1, len(order) + 1))
    assert [whole[r[1]] for r in sorted(rows, key=lambda r: (-r[2], r[1]))] == list(range(1, 3001))
    assert with_rank(df.limit(0), [F.col("k")]).count() == 0


# Quantiles


@pytest.mark.parametrize("sorted_rows", [100_000, 40])
def test_quantiles_when_one_band_holds_nearly_all(spark, monkeypatch, sorted_rows):
    """90 % of a group in one band, all distinct; ties; a group of one; no task sorts more than SORTED_ROWS rows."""
    rng = np.random.default_rng(9)
    groups = {
        "crowded": np.concatenate([1000 + rng.random(1800) * 0.4, rng.normal(0, 500, 200)]),
        "tied": np.repeat([3.0, 3.5, -2.0], [500, 400, 300]),
        "signed": rng.normal(0, 1e-3, 700),
        "one": np.array([7.25]),
    }
    monkeypatch.setattr(quantiles, "SORTED_ROWS", sorted_rows)
    sorted_at_once = []
    plain = quantiles._inside

    def watch(keyed, targets, group):
        sorted_at_once.append(targets.filter("_hi > _lo").agg(F.max("_in_band")).first()[0] or 0)
        return plain(keyed, targets, group)

    monkeypatch.setattr(quantiles, "_inside", watch)
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"lo": 0.0, "a": 0.01, "q": 0.25, "m": 0.5, "x": 0.937, "hi": 1.0}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert sorted_at_once[-1] <= sorted_rows and (len(sorted_at_once) > 1) == (sorted_rows == 40)
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5), abs=1e-12)


def test_groups_are_counted_by_their_last_column_first(spark):
    """No day with more rows than a task may sort: no group can be hot, and names are not even read."""
    rows = [("p", d, float(v)) for d in range(3) for v in (4, 1, 1)]
    df = spark.createDataFrame(rows, "canonical_name string, date int, x double")
    out = levels.with_position(df, ["canonical_name", "date"], "x", sizes=df.select("date"), hot_rows=3)
    assert sorted((r["date"], r["x"], r["_count"], r["_sum"], r["_lower"]) for r in out.collect()) == [
        (d, x, 3, 6.0, n) for d in range(3) for x, n in ((1.0, 0), (1.0, 0), (4.0, 2))
    ]
    hot = levels.with_position(df, ["canonical_name", "date"], "x", hot_rows=2)
    assert sorted(map(tuple, hot.select(*out.columns).collect())) == sorted(map(tuple, out.collect()))
