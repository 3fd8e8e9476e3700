"""The named queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [
    "clean_listings", "contract_violations", "dim_product", "fact_price_daily", "market_overview", "basket_all_coverage",
    "competitive_loo", "asof_lookup", "group_sample", "price_leadership", "seasonal_decompose", "canonical_clusters", "page_json",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(records, columns):
    order = sorted(columns)
    return sorted(tuple(repr(float(r[c]) + 0.0) if isinstance(r[c], (int, float)) and not isinstance(r[c], bool) else str(r[c]) for c in order) for r in records)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, sf, name):
    got = contract.queries()[name](spark, sf)
    cur = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    expect = [dict(zip(columns, r)) for r in cur.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(expect, columns)


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 5
