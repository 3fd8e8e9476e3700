"""Raw price files."""

from __future__ import annotations

import csv
import logging
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleframe.sources.tables import path_exists

log = logging.getLogger(__name__)

TYPED_SCHEMA = (
    "supermarket string, `prices_(£)` double, `prices_unit_(£)` double, unit string, "
    "names string, date string, category string, own_brand string"
)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    found = []
    for p in paths:
        if path_exists(spark, p):
            found.append(p)
        else:
            log.warning("raw file not found, skipped: %s", p)
    return found


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column one of them lacks is null there.

    Where types differ, a text side makes the column text, otherwise Spark
    widens the numbers.
    """
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    as_text = {c for c, t in kinds.items() if len(t) > 1 and "string" in t}
    aligned = [
        df.withColumns({c: F.col(f"`{c}`").cast("string") for c in df.columns if c in as_text})
        if as_text & set(df.columns)
        else df
        for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def files_of(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or pattern names, folders opened one level deep; hidden ones are left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for hit in fs.globStatus(path) or []:
        for f in fs.listStatus(hit.getPath()) if hit.isDirectory() else [hit]:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                out.append(f.getPath().toString())
    return sorted(out)


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a file; none for an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    plain = codec.createInputStream(stream) if codec is not None else stream
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
    try:
        first = lines.readLine()
    finally:
        lines.close()
    return tuple(next(csv.reader([first.removeprefix("﻿")]), ())) if first else ()


def by_header(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line; empty files are in no group."""
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: header_of(spark, p), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(files, headers):
        if header:
            groups.setdefault(header, []).append(path)
    return groups


def read_with_schema(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame | None:
    """The schema's columns, found by name in each file's own header; None if all files are empty.

    A column that a file lacks is null there, and one that the schema lacks is
    not read.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    frames = []
    for header, paths in by_header(spark, files).items():
        own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
        df = spark.read.schema(own).option("header", True).csv(paths)
        frames.append(
            df.select(*[(F.col(f"`{c}`") if c in header else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])
        )
    return reduce(DataFrame.unionByName, frames) if frames else None


def read_raw_csvs(spark: SparkSession, paths: list[str], infer_types: bool = False, multiline: bool = False) -> DataFrame:
    """All listed files that exist; an error when none does.

    Files with one header are one read. Everything is read as text and typed
    later by the cleaning step, which saves the extra pass of type inference.
    ``infer_types`` reads every row to infer. ``multiline`` allows line breaks
    inside quoted values (not in the header) at the price of unsplittable files.
    """
    found = present(spark, paths)
    if not found:
        raise FileNotFoundError(f"No raw CSV files found among {paths}")
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    if infer_types:
        reader = reader.option("inferSchema", True).option("samplingRatio", 1.0)
    groups = by_header(spark, [f for p in found for f in files_of(spark, p)])
    # Files without a line hold nothing; with no others, the result has no column either.
    return union_by_name([reader.csv(files) for files in groups.values()] or [reader.csv(found)])


def read_typed_csvs(spark: SparkSession, pattern: str, schema: str = TYPED_SCHEMA) -> DataFrame:
    """All files matching a pattern with declared types, columns found by header; the date stays text."""
    wanted = T.StructType.fromDDL(schema)
    files = files_of(spark, pattern)
    if not files:
        raise FileNotFoundError(f"No file matches {pattern}")
    df = read_with_schema(spark, files, wanted)
    return df if df is not None else spark.createDataFrame([], wanted)


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows read from each source file."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"))
