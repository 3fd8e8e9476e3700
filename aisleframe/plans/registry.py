"""Named queries over the driver tables, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Prices are fractions of pennies, so a mean may end exactly on half a unit of
# the last digit, and two engines may sum it a hair above or below. The nudge
# moves such values off the edge on both sides.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = 6, columns: list[str] | None = None, nudge: bool = False) -> DataFrame:
    """Round the computed doubles (all of them unless named), as the SQL side does."""
    names = columns if columns is not None else [c for c, t in df.dtypes if t == "double"]
    shift = F.lit(NUDGE if nudge else 0.0)
    return df.withColumns({c: F.round(F.col(c) + shift if nudge else F.col(c), digits) for c in names}) if names else df
