import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.errors import ContractBroken, MissingTable
from aisleframe.functions.sampling import sample_groups, sample_rows
from aisleframe.operators.forecast import TreeParams
from aisleframe.plans import stages
from aisleframe.sources import records, tables
from aisleframe.streaming.incremental import ingest_new_files

from conftest import day

HEADER = "supermarket,prices_(£),prices_unit_(£),unit,names,date,category,own_brand\n"
LISTINGS = [
    ("Tesco", "Oat Crackers Sea Salt", "bakery", "True"),
    ("Aldi", "Sea Salt Oat Crackers", "bakery", "TRUE"),
    ("Tesco", "Green Olives Jar", "food_cupboard", "False"),
    ("Aldi", "Green Olives Jar", "food_cupboard", "FALSE"),
    ("Morrisons", "Green Olives Jar", "food_cupboard", "False"),
    ("ASDA", "Peach Iced Tea", "drinks", "False"),
]
#: No name, no price, and a price of zero: the first two go.
ODD_LINES = [
    "Tesco,2.5,2.5,l,,20240103,drinks,False",
    "Tesco,,2.5,l,Lost Label,20240103,drinks,False",
    "ASDA,0.0,0.0,unit,Paper Straw,20240104,home,False",
]


def raw_lines():
    lines = [
        f"{s},{2 + 0.3 * i + (d % 5) * 0.05:.2f},2.0,unit,{n},{day(d):%Y%m%d},{c},{b}"
        for i, (s, n, c, b) in enumerate(LISTINGS)
        for d in range(30)
    ]
    return [*lines, *ODD_LINES]


def make_toy_encoder():
    """Nested, so that tasks receive it by value: they cannot import a test module."""

    def encoder():
        def encode(texts):
            """One axis per product word; the swapped cracker name leans 11 degrees to a fifth axis."""
            words = ["crackers", "olives", "tea", "straw"]
            out = np.array([[float(w in t) for w in words] + [0.2 * ("salt oat" in t)] for t in texts])
            return out / np.linalg.norm(out, axis=1, keepdims=True)

        return encode

    return encoder


toy_encoder = make_toy_encoder()


@pytest.fixture(scope="module")
def layout(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "raw").mkdir()
    (root / "raw" / "all.csv").write_text(HEADER + "\n".join(raw_lines()) + "\n", encoding="utf-8")
    return stages.Layout(str(root), [str(root / "raw" / "all.csv"), str(root / "raw" / "missing.csv")])


def test_whole_flow(spark, layout, tmp_path):
    with pytest.raises(MissingTable):
        stages.run_matching(spark, layout)
    first = stages.run_ingestion(spark, layout)
    assert (first.rows_in, first.rows_out) == (183, 181)
    clean = spark.read.parquet(first.path)
    assert clean.filter("prices = 0").count() == 1

    assert not stages.run_matching(spark, layout, toy_encoder).skipped
    canonical = spark.read.parquet(layout.table("canonical"))
    named = canonical.groupBy("canonical_name").agg(F.count("*").alias("n"), F.count_distinct("supermarket").alias("stores"))
    assert {(r.canonical_name, r.n, r.stores) for r in named.collect()} == {
        ("oat crackers sea salt", 60, 2), ("green olives jar", 90, 3), ("peach iced tea", 30, 1), ("paper straw", 1, 1),
    }
    assert canonical.filter("own_brand").count() == 60

    assert stages.run_features(spark, layout).rows_out == 181
    assert stages.run_marts(spark, layout)["dim_product"].rows_out == 4
    stages.run_market(spark, layout)
    stages.run_training(spark, layout, TreeParams(n_trees=3, n_leaves=4, min_rows_per_leaf=2), n_boot=20)
    stages.run_contributions(spark, layout, n_samples=5)
    stages.run_anomalies(spark, layout)
    assert spark.read.parquet(layout.table("anomalies")).count() == 181

    # A second run has nothing to do; force does it again.
    assert stages.run_ingestion(spark, layout).skipped and stages.run_matching(spark, layout, toy_encoder).skipped
    assert not stages.run_ingestion(spark, layout, force=True).skipped

    baskets = tmp_path / "baskets.txt"
    baskets.write_text("Snacks:\n- oat crackers sea salt\n- green olives jar\n", encoding="utf-8")
    docs = stages.run_web_artifacts(spark, layout, str(baskets))
    page = spark.read.json(docs["basket_analysis"]).first()
    assert page.basket == "Snacks" and page.total_items == 2 and len(page["rows"]) == 3
    home = spark.read.json(docs["home_metrics"]).first()
    assert home.total_records == 181 and home.canonical_products == 4
    assert spark.read.parquet(layout.table("web/predictor_context")).count() == 7

    reports = records.read_run_reports(spark, layout.reports)
    stages_told = {r.stage for r in reports.collect()}
    assert {"ingestion", "product_matching", "feature_engineering", "training", "contributions", "anomalies"} <= stages_told
    assert {"hhi_index", "market_dispersion", "price_leadership"} <= stages_told
    told = reports.filter("stage = 'training'").first()
    assert told.rows_out == told.n_train_rows + told.n_test_rows <= told.rows_in and told.n_trees >= 1
    assert reports.filter("stage = 'ingestion'").first().row_delta == -2


def test_a_broken_contract_keeps_the_old_table(spark, tmp_path):
    raw = tmp_path / "a.csv"
    raw.write_text(HEADER + "Tesco,1.0,1.0,kg,Tea,20240101,drinks,True\n", encoding="utf-8")
    layout = stages.Layout(str(tmp_path / "run"), [str(raw)])
    stages.run_ingestion(spark, layout)
    raw.write_text(HEADER + "Tesco,-1.0,1.0,kg,Tea,20240101,drinks,True\nNobody,1,1,kg,Tea,20240101,drinks,True\n", encoding="utf-8")
    with pytest.raises(ContractBroken) as e:
        stages.run_ingestion(spark, layout, force=True)
    assert e.value.failures == {"price_not_negative": 1, "known_retailer": 1}
    assert spark.read.parquet(layout.table("clean")).first().prices == 1.0


def test_manifest_and_changes(spark, tmp_path):
    table, source = str(tmp_path / "t"), tmp_path / "src.csv"
    source.write_text("x", encoding="utf-8")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert records.load_manifest(spark, table) is None and records.sources_changed(spark, [str(source)], table)
    tables.write_table(df, table)
    records.write_manifest(df, table, [str(source)], "demo", 1)
    m = records.load_manifest(spark, table)
    assert m["rows"] == 1 and [f["name"] for f in m["schema"]["fields"]] == ["k", "v"] and m["inputs"] == ["src.csv"]
    assert records.schema_hash(df.select("v", "k")) == m["schema_hash"]
    assert not records.sources_changed(spark, [str(source)], table)
    assert records.sources_changed(spark, [str(source), str(tmp_path / "more.csv")], table)
    import os
    import time

    os.utime(source, (time.time() + 60, time.time() + 60))
    assert records.sources_changed(spark, [str(source)], table)
    tables.write_text(spark, records.manifest_path(table), "{broken")
    assert records.load_manifest(spark, table) is None


def test_report_warns_on_heavy_loss_only(spark, tmp_path, caplog):
    def report(rows_in, rows_out):
        caplog.clear()
        records.write_run_report(spark, str(tmp_path / "r"), "s", rows_in, rows_out, 1.0, {"a": 2, "b": 0}, "h", {"note": "n"})
        return any("dropped" in m for m in caplog.messages)

    assert report(100, 70) and not report(100, 90) and not report(100, 150) and not report(0, 0)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(rows) == 4 and rows[0]["null_counts"] == {"a": 2} and rows[0]["note"] == "n"


def test_read_is_pruned(spark, tmp_path):
    tables.write_table(spark.createDataFrame([(1, "a", 2.0)], "k int, v string, w double"), str(tmp_path / "t"))
    plan = tables.read_table(spark, str(tmp_path / "t"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int>" in plan


def test_incremental_folder(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    args = (spark, str(raw), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    (raw / "1.csv").write_text(HEADER + "\n".join(raw_lines()[:10]) + "\n", encoding="utf-8")
    assert ingest_new_files(*args) == 10
    (raw / "2.csv").write_text(HEADER + "\n".join(ODD_LINES) + "\n", encoding="utf-8")
    assert ingest_new_files(*args) == 3
    assert ingest_new_files(*args) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_incremental_files_are_read_by_their_own_header(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "1.csv").write_text("names,prices_(£),date,supermarket\nTea,1.5,20240101,Tesco\n", encoding="utf-8")
    (raw / "2.csv").write_text(HEADER + "Aldi,2.5,2.5,kg,Jam,20240102,food,True\n", encoding="utf-8")
    (raw / "3.csv").write_text("", encoding="utf-8")
    assert ingest_new_files(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_batch=1) == 2
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.supermarket, r.product_name, r.prices, r.category) for r in rows} == {
        ("Tesco", "Tea", 1.5, None), ("Aldi", "Jam", 2.5, "food"),
    }


def test_incremental_takes_all_files_in_batches_of_bounded_size(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(7):
        (raw / f"{i}.csv").write_text(HEADER + f"Aldi,2.5,2.5,kg,Jam {i},20240102,food,True\n", encoding="utf-8")
    assert ingest_new_files(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_batch=3) == 7
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.select("product_name").distinct().count() == 7 and rows.select("ingest_batch").distinct().count() == 3


def test_promotion_that_fails_keeps_the_old_table(spark, tmp_path):
    final = str(tmp_path / "t")
    tables.write_table(spark.range(3), final)
    with pytest.raises(Exception):
        tables.promote(spark, str(tmp_path / "never_written"), final)
    assert spark.read.parquet(final).count() == 3
    tables.write_table(spark.range(5), final + ".staged")
    tables.promote(spark, final + ".staged", final)
    assert spark.read.parquet(final).count() == 5 and not (tmp_path / "t.previous").exists()


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.concat(F.lit("g"), F.col("id") % 37))
    a = {r.id for r in sample_rows(df.repartition(7), 50, ["id"]).collect()}
    b = {r.id for r in sample_rows(df.repartition(2), 50, ["id"]).collect()}
    assert a == b and len(a) == 50
    kept = sample_groups(df, "g", 10)
    assert kept.select("g").distinct().count() == 3
    assert kept.count() == sum(df.filter(F.col("g") == r.g).count() for r in kept.select("g").distinct().collect())
