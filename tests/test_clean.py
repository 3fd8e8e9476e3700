import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from aisleframe.errors import ContractBroken
from aisleframe.operators import clean, contracts
from aisleframe.sources import raw

HEADER = "supermarket,prices_(£),prices_unit_(£),unit,names,date,category,own_brand\n"


def write(path, text):
    path.write_text(HEADER + text, encoding="utf-8")
    return str(path)


@pytest.fixture
def dirty(tmp_path):
    return write(
        tmp_path / "a.csv",
        "Tesco, 1.50 ,1.5,kg,  Baked Beans  ,20240101,food,True\n"
        "ASDA,2.00,2.0,kg,Bread,20240102,bakery,FALSE\n"
        "ASDA,,2.0,kg,Milk,20240102,drinks,False\n"
        "Aldi,0.0,0.0,kg,,20240102,drinks,False\n",
    )


def test_clean_trims_types_and_drops(spark, dirty):
    counts = Observation()
    rows = sorted(clean.clean(raw.read_raw_csvs(spark, [dirty]), counts).collect(), key=lambda r: r.product_name)
    assert [(r.product_name, r.prices, r.date) for r in rows] == [
        ("Baked Beans", 1.5, dt.date(2024, 1, 1)),
        ("Bread", 2.0, dt.date(2024, 1, 2)),
    ]
    assert counts.get == {"rows_in": 4, "no_price": 1, "no_name": 1}


def test_blank_name_and_zero_price_survive(spark):
    df = spark.createDataFrame([("Aldi", "0.0", "   ", "20240101")], "supermarket string, prices string, names string, date string")
    row = clean.clean(df).first()
    assert row.prices == 0.0 and row.product_name == ""


def test_unreadable_numbers_and_dates_are_null(spark):
    df = spark.createDataFrame([("1.5d",), ("NaN",), ("1e2",), ("abc",), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(clean.to_number(F.col("v"))).collect()] == [None, None, 100.0, None, 7.0]
    df = spark.createDataFrame([("20240230",), ("2024-01-01",), ("20240229",)], "v string")
    assert [r[0] for r in df.select(clean.to_day(F.col("v"))).collect()] == [None, None, dt.date(2024, 2, 29)]


def test_flags_of_any_case(spark):
    df = spark.createDataFrame([("True",), ("TRUE",), ("false",), ("yes",), (None,)], "v string")
    assert [r[0] for r in df.select(clean.to_flag(F.col("v"))).collect()] == [True, True, False, False, False]


def test_missing_files_are_skipped_and_none_is_an_error(spark, dirty, tmp_path):
    assert raw.read_raw_csvs(spark, [dirty, str(tmp_path / "no.csv")]).count() == 4
    with pytest.raises(FileNotFoundError):
        raw.read_raw_csvs(spark, [str(tmp_path / "no.csv")])


def test_typed_glob_and_rows_per_file(spark, dirty, tmp_path):
    write(tmp_path / "All_Data_x.csv", "Tesco,1.0,1.0,kg,Tea,20240101,drinks,True\n")
    write(tmp_path / "All_Data_y.csv", "Tesco,1.0,1.0,kg,Tea,20240101,drinks,True\nASDA,2,2,kg,Jam,20240101,food,False\n")
    df = raw.read_typed_csvs(spark, str(tmp_path / "All_Data_*.csv"))
    assert dict(df.dtypes)["prices_(£)"] == "double" and dict(df.dtypes)["date"] == "string"
    assert sorted(r.n_rows for r in raw.rows_per_file(df).collect()) == [1, 2]


def test_typed_columns_follow_each_files_header(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("prices_(£),extra,supermarket,names\n1.5,x,Tesco,Tea\n", encoding="utf-8")
    write(tmp_path / "p2.csv", "ASDA,2,2,kg,Jam,20240101,food,False\n")
    (tmp_path / "p3.csv").write_text("", encoding="utf-8")
    rows = raw.read_typed_csvs(spark, str(tmp_path / "p*.csv")).collect()
    assert {(r.supermarket, r["prices_(£)"], r.names, r.unit) for r in rows} == {
        ("Tesco", 1.5, "Tea", None), ("ASDA", 2.0, "Jam", "kg"),
    }
    listed = [str(tmp_path / f"p{i}.csv") for i in (1, 2, 3)]
    assert raw.read_raw_csvs(spark, listed).filter("names = 'Jam' AND extra IS NULL").count() == 1


def test_inferred_types(spark, dirty):
    assert dict(raw.read_raw_csvs(spark, [dirty], infer_types=True).dtypes)["date"] == "int"


def test_union_fills_missing_columns_and_settles_types(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2.5, 3)], "k double, v int")
    c = spark.createDataFrame([(9,)], "extra int")
    out = raw.union_by_name([a, b, c])
    assert dict(out.dtypes) == {"k": "double", "v": "string", "extra": "int"}
    assert sorted((str(r.k), str(r.v)) for r in out.collect()) == [("1.0", "x"), ("2.5", "3"), ("None", "None")]


RAW = "date date, product_name string, prices double, supermarket string"


@pytest.mark.parametrize(
    "row, rule",
    [
        ((dt.date(2024, 1, 1), "a", -1.0, "Tesco"), "price_not_negative"),
        ((dt.date(2024, 1, 1), "a", 10001.0, "Tesco"), "price_not_above_limit"),
        ((dt.date(2024, 1, 1), "a", 1.0, "Corner Shop"), "known_retailer"),
        ((None, "a", 1.0, "Tesco"), "date_present"),
    ],
)
def test_raw_contract_names_the_broken_rule(spark, row, rule):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "ok", 1.0, "Tesco"), row], RAW)
    with pytest.raises(ContractBroken) as e:
        contracts.raw_contract().enforce(df)
    assert e.value.failures == {rule: 1}
    assert [r.rule for r in contracts.raw_contract().violations(df).collect()] == [rule]


def test_contract_collects_all_or_stops_at_the_first(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", -1.0, "Nobody")], RAW)
    with pytest.raises(ContractBroken) as e:
        contracts.raw_contract().enforce(df)
    assert set(e.value.failures) == {"price_not_negative", "known_retailer"}
    with pytest.raises(ContractBroken) as e:
        contracts.raw_contract().enforce(df, report_all=False)
    assert len(e.value.failures) == 1


def test_contract_is_open_and_needs_its_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.0, "Tesco", 5)], RAW + ", extra int")
    assert "extra" in contracts.raw_contract().enforce(df).columns
    with pytest.raises(ContractBroken):
        contracts.raw_contract().enforce(df.drop("prices"))
