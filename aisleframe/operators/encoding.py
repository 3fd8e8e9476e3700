"""Model inputs: which columns are features and how categories become numbers."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.ranking import with_rank

# Never model inputs (target, keys, and the same row's unit price).
NON_FEATURES = ["prices", "date", "product_name", "canonical_name", "normalised_name", "prices_unit"]
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def feature_columns(df: DataFrame, exclude: list[str] = NON_FEATURES) -> list[str]:
    """Numeric and boolean columns that may be model inputs."""
    return [c for c, t in df.dtypes if c not in exclude and (t in NUMERIC or t.startswith("decimal"))]


def category_columns(df: DataFrame, exclude: list[str] = NON_FEATURES) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and t == "string"]


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric inputs and the category levels seen in training.

    The same object encodes training, test and served rows. The first level
    of a category, null and unseen values are all zeros.
    """

    numeric: list[str]
    levels: dict[str, list[str]]

    @property
    def dummies(self) -> dict[str, tuple[str, str]]:
        """Input name to (column, level); names that would be equal, in any case, get a number."""
        out: dict[str, tuple[str, str]] = {}
        taken = {c.lower() for c in self.numeric}
        for c, known in self.levels.items():
            for level in known[1:]:
                base = name = f"{c}_{level}".replace(".", "_")
                n = 1
                while name.lower() in taken:
                    n += 1
                    name = f"{base}__{n}"
                taken.add(name.lower())
                out[name] = (c, level)
        return out

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.dummies]

    def columns(self, df: DataFrame) -> list[Column]:
        """The inputs in fixed order; a column the table lacks is 0."""
        have = set(df.columns)
        out = [(F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in self.numeric]
        for name, (c, level) in self.dummies.items():
            hit = F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
            out.append(hit.alias(name))
        return out

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *self.columns(df))

    def unresolved(self) -> Column:
        """Names of the inputs that are null in an encoded row."""
        return F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in self.names]))

    def to_json(self) -> str:
        return json.dumps({"numeric": self.numeric, "levels": self.levels})

    @staticmethod
    def from_json(text: str) -> FeatureSpec:
        return FeatureSpec(**json.loads(text))


def fit_spec(train: DataFrame, exclude: list[str] = NON_FEATURES) -> FeatureSpec:
    """Read the category levels of the training rows in one pass.

    Each level becomes a column of the encoded table, so their list reaches
    the driver with the plan; exclude columns that identify rows.
    """
    categories = category_columns(train, exclude)
    levels: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in categories])
        seen = (
            train.select(F.explode(pairs).alias("p"))
            .select("p.c", "p.v")
            .filter(F.col("v").isNotNull())
            .distinct()
            .collect()
        )
        for r in seen:
            levels[r["c"]].append(r["v"])
    return FeatureSpec(feature_columns(train, exclude), {c: sorted(v) for c, v in levels.items()})


def spec_and_cutoff(features: DataFrame, days: int = 7, exclude: list[str] = NON_FEATURES) -> tuple[FeatureSpec, dt.date | None]:
    """``fit_spec`` of the training rows that ``time_split`` gives and their newest possible day, in one pass over few columns.

    A level belongs to the training rows if the first day it is seen on does.
    """
    categories = category_columns(features, exclude)
    text = [F.struct(F.lit(j).alias("c"), F.col(f"`{c}`").alias("v")) for j, c in enumerate(categories)]
    pairs = F.array(F.struct(F.lit(-1).alias("c"), F.lit(None).cast("string").alias("v")), *text)
    spans = features.select("date", F.explode(pairs).alias("p")).groupBy("p.c", "p.v")
    seen = spans.agg(F.min("date").alias("first"), F.max("date").alias("last")).collect()
    newest = max((r["last"] for r in seen if r["last"] is not None), default=None)
    cutoff = newest - dt.timedelta(days) if newest is not None else None
    levels: dict[str, list[str]] = {c: [] for c in categories}
    for r in seen:
        if r["c"] >= 0 and r["v"] is not None and r["first"] is not None and r["first"] <= cutoff:
            levels[categories[r["c"]]].append(r["v"])
    return FeatureSpec(feature_columns(features, exclude), {c: sorted(v) for c, v in levels.items()}), cutoff


def level_table(train: DataFrame, categories: list[str]) -> DataFrame:
    """(category, level, position): every level of every category but the first, positions in one sequence.

    Categories keep the order given and levels are sorted inside them, as in
    ``FeatureSpec``; nothing of it passes through the driver but one count per
    category, so a category may have any number of levels.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").cast("string").alias("level")) for c in categories])
    seen = train.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("level").isNotNull()).distinct()
    ranks = with_rank(seen, [F.col("level")], within="category", name="_rank")
    sizes = {r["category"]: r["n"] for r in ranks.groupBy("category").agg(F.max("_rank").alias("n")).collect()}
    offset, start = {}, 0
    for c in categories:
        offset[c] = start
        start += max(sizes.get(c, 0) - 1, 0)
    first = F.create_map(*[x for c in categories for x in (F.lit(c), F.lit(offset[c]))])
    return ranks.filter("_rank > 1").select("category", "level", (first[F.col("category")] + F.col("_rank") - 2).alias("position"))


def encode_sparse(rows: DataFrame, levels: DataFrame, categories: list[str], name: str = "active") -> DataFrame:
    """Adds ``name``: the sorted positions of a row's levels, the ones of its one-hot vector.

    One left join by value per category: the plan grows with the categories and
    not with their levels. The first level, nulls and unseen values have no
    position. Spark broadcasts the levels of a category while they are few and
    splits a level that holds many rows otherwise.
    """
    out = rows
    for j, c in enumerate(categories):
        mine = levels.filter(F.col("category") == c).select(F.col("level").alias(f"_level{j}"), F.col("position").alias(f"_position{j}"))
        out = out.join(mine, F.col(f"`{c}`").cast("string") == F.col(f"_level{j}"), "left").drop(f"_level{j}")
    found = [f"_position{j}" for j in range(len(categories))]
    return out.withColumn(name, F.sort_array(F.array_compact(F.array(*found)))).drop(*found)


def time_split(df: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``days`` before the newest date, and the rows after that."""
    cutoff = df.agg(F.date_sub(F.max("date"), days).alias("d")).scalar()
    return df.filter(F.col("date") <= cutoff), df.filter(F.col("date") > cutoff)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the columns.

    Written as separate conditions: each can be pushed to a scan, and the
    optimiser's derived constraints stay one column wide (a single n-column
    condition multiplies with every later alias).
    """
    return df.filter(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns]))


def override_lag(df: DataFrame, override: str = "price_override") -> DataFrame:
    """What if yesterday's price had been different: only that field changes."""
    return df.withColumn("price_lag_1d", F.coalesce(F.col(override), F.col("price_lag_1d")))
