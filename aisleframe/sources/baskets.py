"""Basket definitions: name to product list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_baskets(text: str) -> dict[str, list[str]]:
    """Read the plain two-level list form: ``Name:`` lines and ``- item`` lines."""
    out: dict[str, list[str]] = {}
    current: list[str] | None = None
    for line in text.splitlines():
        body = line.split(" #")[0].strip() if not line.lstrip().startswith("#") else ""
        if not body:
            continue
        if body.startswith("- "):
            if current is None:
                raise ValueError("basket item before any basket name")
            current.append(body[2:].strip().strip("'\""))
        elif body.endswith(":"):
            current = out.setdefault(body[:-1].strip().strip("'\""), [])
        else:
            raise ValueError(f"not a basket line: {line!r}")
    return out


def baskets_frame(spark: SparkSession, baskets: dict[str, list[str]]) -> DataFrame:
    """(basket, canonical_name), one row per listed item."""
    rows = spark.createDataFrame(list(baskets.items()), "basket string, items array<string>")
    return rows.select("basket", F.explode("items").alias("canonical_name"))


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """The definition file; it is a configuration file of a few hundred lines."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    return baskets_frame(spark, parse_baskets("\n".join(lines)))
