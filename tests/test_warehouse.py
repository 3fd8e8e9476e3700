import pytest
from pyspark.sql import functions as F

from aisleframe.operators import market, marts, warehouse
from aisleframe.sources.baskets import baskets_frame, parse_baskets

from conftest import day

ROWS = [
    ("bananas", "Tesco", day(0), 1.0, "fruit", True), ("bananas", "Tesco", day(0), 1.2, "produce", True),
    ("bananas", "Tesco", day(0), 1.4, "produce", False), ("bananas", "ASDA", day(0), 0.9, "produce", False),
    ("milk", "Tesco", day(0), 1.1, "dairy", True), ("milk", "Tesco", day(1), 1.2, "dairy", True),
    ("milk", "Aldi", day(1), 1.0, "dairy", False), ("bananas", "Tesco", day(1), 0.99, "produce", True),
    ("100% juice", "Morrisons", day(0), 2.0, "drinks", False),
]


@pytest.fixture(scope="module")
def canonical(spark):
    return spark.createDataFrame(ROWS, "canonical_name string, supermarket string, date date, prices double, category string, own_brand boolean")


@pytest.fixture(scope="module")
def fact(canonical):
    return marts.fact_price_daily(canonical)


@pytest.fixture(scope="module")
def dim(canonical):
    return marts.dim_product(canonical)


def test_marts(canonical, fact, dim):
    assert [r[0] for r in marts.dim_retailer(canonical).collect()] == ["ASDA", "Aldi", "Morrisons", "Tesco"]
    row = fact.filter("canonical_name = 'bananas' and supermarket = 'Tesco' and n_listings = 3").first()
    assert (row.avg_price, row.min_price, row.max_price) == (pytest.approx(1.2), 1.0, 1.4)
    bananas = dim.filter("canonical_name = 'bananas'").first()
    assert (bananas.category, bananas.n_retailers, bananas.first_seen_date, bananas.last_seen_date) == ("produce", 2, day(0), day(1))


def test_overview(fact, dim):
    rows = {r.supermarket: r for r in warehouse.market_overview(fact, dim).collect()}
    assert rows["Tesco"].portfolio_size == 2
    assert rows["Tesco"].own_brand_count + rows["Tesco"].branded_count == 4
    assert rows["Tesco"].min_price == 0.99 and rows["Tesco"].price_median == pytest.approx(1.15)


def test_search_takes_wildcards_literally(dim):
    assert [r.canonical_name for r in warehouse.search_products(dim, "%").collect()] == ["100% juice"]
    assert warehouse.search_products(dim, "_").count() == 0
    assert [r.canonical_name for r in warehouse.search_products(dim, "MILK").collect()] == ["milk"]
    assert warehouse.type_ahead(dim, "m").count() == 0


def test_history(spark, fact):
    assert warehouse.product_history(fact, "bananas").count() == 3
    assert warehouse.product_history(fact, "nothing").count() == 0
    asked = spark.createDataFrame([("milk", "Aldi"), ("milk", "Morrisons"), ("bananas", None)], "canonical_name string, supermarket string")
    got = warehouse.product_histories(fact, asked).groupBy("canonical_name", "status").count().collect()
    assert {(r.canonical_name, r.status): r["count"] for r in got} == {("milk", "ok"): 1, ("milk", "not_found"): 1, ("bananas", "ok"): 3}


def test_baskets(spark, fact):
    items = spark.createDataFrame([("bananas",), ("milk",), ("unknown",)], "canonical_name string")
    cost = {r.supermarket: (r.basket_cost, r.items_found) for r in warehouse.basket_cost(fact, items).collect()}
    assert cost == {"Tesco": (pytest.approx(2.19), 2), "Aldi": (1.0, 1)}
    assert warehouse.basket_items(fact, items).count() == 3
    assert warehouse.basket_cost(fact, items.limit(0)).columns == ["supermarket", "basket_cost", "items_found"]
    assert warehouse.basket_cost(fact, items.limit(0)).count() == 0
    baskets = baskets_frame(spark, {"Test": ["bananas", "milk"]})
    rows = {r.supermarket: r.coverage_pct for r in warehouse.basket_coverage(fact, baskets).collect()}
    assert rows["Tesco"] == 100 and rows["Aldi"] == 50
    ranked = warehouse.basket_ranking(warehouse.basket_coverage(fact, baskets)).first()
    assert ranked.savings_pct == pytest.approx((2.19 - 1.0) / 2.19 * 100)
    grid = {r.canonical_name: r.asDict() for r in warehouse.price_grid(warehouse.basket_items(fact, items), ["Aldi", "Tesco"]).collect()}
    assert grid["bananas"]["Aldi"] is None and grid["milk"]["Tesco"] == 1.2


def test_basket_text():
    text = "# comment\nFirst:\n- a b\n- 'c'\nSecond:\n- d\n"
    assert parse_baskets(text) == {"First": ["a b", "c"], "Second": ["d"]}
    with pytest.raises(ValueError):
        parse_baskets("- loose\n")


def test_hhi_classes_and_fallback(spark):
    rows = [("even", s) for s in "ABCDEFGHIJ"] + [("mono", "A")] * 3 + [("four", s) for s in "ABCD"]
    df = spark.createDataFrame(rows, "category string, supermarket string")
    got = {r.category: (r.hhi, r.concentration) for r in market.hhi(df).collect()}
    assert got == {"even": (1000, "Competitive"), "mono": (10000, "Highly Concentrated"), "four": (2500, "Moderate")}
    assert "canonical_name" in market.hhi(df.withColumnRenamed("category", "canonical_name")).columns


def test_dispersion(spark):
    df = spark.createDataFrame(
        [("a", day(0), 1.0), ("a", day(0), 3.0), ("b", day(0), 5.0), ("z", day(1), 0.0), ("z", day(1), 0.0)],
        "canonical_name string, date date, prices double",
    )
    got = {r.date: r.dispersion for r in market.dispersion(df).collect()}
    assert got[day(0)] == pytest.approx(2**0.5 / 2) and got[day(1)] == 0
    flat = market.dispersion_summary(market.dispersion(df).filter(F.col("date") == day(0))).first()
    assert flat.competitiveness_index == 100
