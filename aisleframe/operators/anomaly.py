"""Isolation forest on four price features (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.quantiles import exact_quantiles
from aisleframe.functions.sampling import first_k_per_group
from aisleframe.operators.encoding import complete_cases
from aisleframe.session import settle

FEATURES = ["prices", "price_diff_1d", "price_rol_std_7d", "price_vs_market_avg"]
KEYS = ["supermarket", "product_name", "date"]
N_TREES = 100
TREE_ROWS = 256
#: Rows that a task scores at a time, so that what it works on stays near the core.
SCORED_TOGETHER = 8_192

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One tree as node rows; a leaf has feature -1 and its expected path length."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list[list[float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = me
        sub = x[rows]
        varied = np.nonzero(sub.min(axis=0) < sub.max(axis=0))[0] if len(rows) > 1 else []
        if depth >= limit or len(varied) == 0:
            nodes.append([tree, me, -1, 0.0, -1, -1, depth + expected_depth(len(rows))])
            continue
        f = int(rng.choice(varied))
        cut = rng.uniform(sub[:, f].min(), sub[:, f].max())
        nodes.append([tree, me, f, cut, -1, -1, 0.0])
        below = sub[:, f] <= cut
        todo.append((rows[~below], depth + 1, me, 1))
        todo.append((rows[below], depth + 1, me, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])


def draw_for_trees(rows: DataFrame, features: list[str], keys: list[str], n_trees: int, tree_rows: int, seed: int) -> DataFrame:
    """(tree, draw, x): for each tree the ``tree_rows`` rows with the least hash, of all rows.

    A row has a hash of its own for every tree, so each tree draws from the
    whole table however it is partitioned. The number of rows tells below which
    hash a tree's rows lie, with room to spare, so a task passes on about that
    many rows a tree and no more; should a tree get too few, the bound is widened.
    """
    narrow = rows.select(F.xxhash64(F.lit(seed), *keys).alias("h"), *[F.col(c).cast("double") for c in features])
    total = rows.count()
    bound = tree_rows + 10 * int(np.sqrt(tree_rows)) + 20

    def draw(share: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                x = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
                for tree in range(n_trees):
                    mine = _scramble(h, tree)
                    rows_in = np.nonzero(mine <= np.uint64(min(int(share * 2.0**64), (1 << 64) - 1)))[0]
                    if len(rows_in):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "tree": pa.array(np.full(len(rows_in), tree, np.int32)),
                                # Unsigned order as signed numbers.
                                "draw": pa.array((mine[rows_in] ^ np.uint64(1 << 63)).view(np.int64)),
                                "x": pa.array(list(x[rows_in]), pa.list_(pa.float64())),
                            }
                        )

        return narrow.mapInArrow(run, "tree int, draw long, x array<double>")

    share = min(1.0, bound / max(total, 1))
    while True:
        drawn = settle(draw(share))
        least = drawn.groupBy("tree").count().agg(F.min("count"), F.count("*")).first()
        if share >= 1.0 or (least[1] == n_trees and least[0] >= min(tree_rows, total)):
            return first_k_per_group(drawn, ["tree"], [F.col("draw").asc(), F.col("x").asc()], tree_rows)
        share = min(1.0, share * 2)


def _scramble(h: np.ndarray, tree: int) -> np.ndarray:
    """Another hash of each row for each tree (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def grow_forest(rows: DataFrame, features: list[str], keys: list[str], n_trees: int, tree_rows: int, seed: int) -> DataFrame:
    """Trees as rows; each is grown from its own draw of all rows."""
    drawn = draw_for_trees(rows, features, keys, n_trees, tree_rows, seed)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(x=pdf["x"].map(tuple)).sort_values(["draw", "x"])
        return _grow(int(key[0]), np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1), seed)

    return drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def _full_tree(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, path lengths) of a tree filled up to its full depth, level by level.

    The children of place k are 2 k + 1 and 2 k + 2. Below a leaf both ways lead to its path length.
    """
    levels, at = 0, {0: 0}
    places = []
    while at:
        places.append(at)
        below = {}
        for place, node in at.items():
            if t[node, 0] >= 0:
                below[2 * place + 1], below[2 * place + 2] = int(t[node, 2]), int(t[node, 3])
        levels, at = levels + bool(below), below
    inner = (1 << levels) - 1
    feature, cut, path = np.zeros(inner, np.intp), np.zeros(inner), np.zeros(inner + 1)
    for level, found in enumerate(places):
        for place, node in found.items():
            if t[node, 0] >= 0:
                feature[place], cut[place] = int(t[node, 0]), t[node, 1]
            else:
                wide = 1 << (levels - level)
                first = (place + 1) * wide - 1 - inner
                path[first : first + wide] = t[node, 4]
    return feature, cut, path


def _paths(x: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the path lengths of every row over the trees, a few rows at a time and all of them level by level."""
    out = np.zeros(len(x))
    for lo in range(0, len(x), SCORED_TOGETHER):
        part = np.ascontiguousarray(x[lo : lo + SCORED_TOGETHER].T)
        rows, flat = np.arange(part.shape[1]), part.reshape(-1)
        total = out[lo : lo + SCORED_TOGETHER]
        for feature, cut, path in trees:
            first, at = feature * len(rows), np.zeros(len(rows), np.intp)
            for _ in range(len(path).bit_length() - 1):
                # Not "greater": a NaN is at most nothing and goes right.
                left = flat.take(first.take(at) + rows) <= cut.take(at)
                at *= 2
                at += 2
                at -= left
            total += path.take(at - len(feature))
    return out


def isolation_scores(
    rows: DataFrame,
    features: list[str] = FEATURES,
    keys: list[str] = KEYS,
    n_trees: int = N_TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Complete rows with ``score`` = 2 ** (-mean path / expected path); higher is odder."""
    spark = rows.sparkSession
    complete = complete_cases(rows, features)
    # At most n_trees * 2 * tree_rows node rows.
    nodes = grow_forest(complete, features, keys, n_trees, tree_rows, seed).toPandas()
    sample_size = min(tree_rows, complete.limit(tree_rows).count())
    scale = expected_depth(sample_size) or 1.0
    trees = [
        t.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy(dtype=np.float64)
        for _, t in nodes.groupby("tree", sort=True)
    ]
    shared = spark.sparkContext.broadcast([_full_tree(t) for t in trees])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=np.float64)
            path = _paths(x, shared.value)
            pdf["score"] = np.exp2(-(path / max(1, len(shared.value))) / scale)
            yield pdf

    schema = complete.select(*keys, *features).schema
    return complete.select(*keys, *features).mapInPandas(score, schema.add("score", "double"))


def detect_anomalies(
    rows: DataFrame,
    contamination: float = 0.01,
    seed: int = 42,
    fill_missing: bool = False,
    n_trees: int = N_TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Add ``is_anomaly``: the rows above the (1 - contamination) quantile of the score.

    Rows with a missing feature are not scored and not flagged, unless
    ``fill_missing`` scores them with zeros. Expects one row per listing-day.
    """
    missing = [c for c in FEATURES if c not in rows.columns]
    if missing:
        raise ValueError(f"feature table lacks {missing}; run the feature stage first")
    used = rows.na.fill(0.0, subset=FEATURES) if fill_missing else rows
    # Settled, as the cut and the flags below each read the scores.
    scored = settle(isolation_scores(used, n_trees=n_trees, tree_rows=tree_rows, seed=seed).select(*KEYS, "score"))
    cut = exact_quantiles(scored, [], "score", {"cut": 1 - contamination}).scalar()
    flagged = scored.filter(F.col("score") > cut).select(*KEYS, F.lit(True).alias("_hit"))
    return rows.join(flagged, KEYS, "left").withColumn("is_anomaly", F.coalesce("_hit", F.lit(False))).drop("_hit")


def anomaly_share(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("is_anomaly").alias("n_anomalies"),
        (F.avg(F.col("is_anomaly").cast("double")) * 100).alias("pct"),
    )
