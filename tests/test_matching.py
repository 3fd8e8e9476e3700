import math
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleframe.functions.numeric import dot, unit_vector
from aisleframe.functions.text import normalise_name
from aisleframe.operators import matching, similarity
from aisleframe.session import settle


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Tesco Finest Bananas 5pk - 1.2kg", "finest bananas"),
        ("Walkers Meaty Variety Crisps 12x25g", "walkers meaty variety crisps"),
        ("Jalapeño  Peppers, 200 G!", "jalapeño peppers"),
        ("Garibaldi Biscuits", "garib biscuits"),
        (None, ""),
        ("   ", ""),
    ],
)
def test_normalise(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "n string").select(normalise_name(F.col("n"))).first()[0] == clean


def brute_force(ids, x, k, min_sim=-1.0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    out = {}
    for i, a in enumerate(ids):
        ranked = sorted(((-round(sims[i, j], 9), b) for j, b in enumerate(ids) if j != i and sims[i, j] >= min_sim))
        out[a] = [b for _, b in ranked[:k]]
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


def test_block_size_follows_memory_and_cores():
    assert similarity.block_rows(2_000, 64, 8) == 4096
    assert similarity.block_rows(114_000, 1024, 8) == 16384
    assert similarity.block_rows(10_000_000, 64, 8000) == 78740


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(unit_vector(F.col("a")).alias("u"), dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.u, r.d) for r in rows] == [([0.6, 0.8], 11.0), ([0.0, 0.0], 0.0)]


@pytest.mark.parametrize("chunk_rows, min_sim", [(None, -1.0), (25, -1.0), (25, 0.6)])
def test_neighbours_equal_brute_force(spark, chunk_rows, min_sim):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = np.float32(np.repeat(centres, 40, axis=0) + 0.3 * rng.normal(size=(240, 8)))
    ids = list(range(240))
    got = {}
    near = similarity.nearest_neighbours(vectors(spark, ids, x), 4, chunk_rows=chunk_rows, min_sim=min_sim)
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    expect = {i: v for i, v in brute_force(ids, x.astype(np.float64), 4, min_sim).items() if v}
    assert got == expect


def test_neighbours_in_small_chunks_and_steps(spark, monkeypatch):
    """What a task holds at a time is bounded, whatever the size of the table."""
    monkeypatch.setattr(similarity, "MIN_BLOCK_ROWS", 30)
    monkeypatch.setattr(similarity, "TASK_BYTES", 30 * 8 * 8)
    monkeypatch.setattr(similarity, "STEP_CELLS", 100)
    x = np.float32(np.random.default_rng(6).normal(size=(200, 8)))
    ids = list(range(200))
    got = {}
    for r in similarity.nearest_neighbours(vectors(spark, ids, x), 3, min_sim=0.3).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == {i: v for i, v in brute_force(ids, x.astype(np.float64), 3, 0.3).items() if v}


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat([[1.0, 0.0, 0.0]], 60, axis=0), rng.normal(size=(60, 3))])
    ids = list(range(120))
    got = {}
    for r in similarity.nearest_neighbours(vectors(spark, ids, x), 5, chunk_rows=20).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == brute_force(ids, np.float32(x).astype(np.float64), 5)


def named(spark, pairs):
    return spark.createDataFrame([(n, [float(v) for v in x]) for n, x in pairs], "normalised_name string, embedding array<float>")


def clusters(spark, pairs, threshold, k=5):
    return {r[0]: r[1] for r in matching.cluster_names(named(spark, pairs), threshold, k).collect()}


def test_chain_joins_and_order_does_not_matter(spark):
    def at(deg):
        return [np.cos(np.radians(deg)), np.sin(np.radians(deg))]

    angles = {"walnut": 5, "hazelnut": 30, "chestnut": 52, "pecan": 75, "kidney bean": 165}
    pairs = [(name, at(deg)) for name, deg in angles.items()]
    expect = {name: "kidney bean" if name == "kidney bean" else "chestnut" for name in angles}
    assert clusters(spark, pairs, 0.9) == expect
    assert clusters(spark, pairs[::-1], 0.9) == expect


def test_a_generic_name_joins_its_mutual_neighbours_only(spark):
    """Each flavour's one neighbour is the plain name, which itself has room for k of them."""
    side = np.eye(13) * np.sqrt(1 - 0.9**2)
    flavours = [(f"yoghurt flavour {i:02d}", [0.9, *row]) for i, row in enumerate(side)]
    out = clusters(spark, [("yoghurt", [1.0] + [0.0] * 13), *flavours], 0.88, k=4)
    assert sum(c == out["yoghurt"] for c in out.values()) == 5


def test_empty_input(spark):
    assert clusters(spark, [], 0.9) == {}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2)) if a != b}
    edges |= {(1000 + i, 1001 + i) for i in range(60)}
    edges |= {(5000, 5001 + i) for i in range(80)}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    expect = {v: find(v) for v in list(parent)}
    df = spark.createDataFrame(list(edges), "src long, dst long")
    assert {r.id: r.component for r in similarity.connected_components(df).collect()} == expect


def test_components_of_few_edges_lie_in_few_partitions(spark, monkeypatch):
    """A round over a small graph has no more tasks than cores to read it, however finely shuffles are cut."""
    settle, parts = similarity.settle, []
    monkeypatch.setattr(similarity, "settle", lambda df: parts.append((out := settle(df)).rdd.getNumPartitions()) or out)
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = similarity.connected_components(edges)
        assert out.count() == 201 and out.filter("component <> 0").count() == 0
        assert len(parts) > 2 and max(parts[1:]) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_model_encoder_runs_in_batches(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = matching.model_vectors(spark.createDataFrame([("ab",), ("abc",)], "normalised_name string"), make, batch=1)
    assert sorted(r.embedding[0] for r in out.collect()) == [9.0, 10.0]


def test_trigram_vectors_are_unit_length(spark):
    out = matching.ngram_vectors(spark.createDataFrame([("red apples",), ("green pears",), ("",)], "normalised_name string"))
    for r in out.collect():
        assert np.linalg.norm(r.embedding) == pytest.approx(1.0, abs=1e-3) or r.normalised_name == ""


def test_visits_grow_slower_than_all_pairs_on_clustered_vectors(spark, monkeypatch):
    """Four times the vectors, four times the clusters: far less than sixteen times the pairs are visited."""
    plain, asked = similarity.settle, []

    def watch(df):
        out = plain(df)
        if "split" in df.columns:
            asked.append(out.count())
        return out

    monkeypatch.setattr(similarity, "settle", watch)
    monkeypatch.setattr(similarity, "MAX_PIVOTS", 8)
    rng = np.random.default_rng(5)
    visited = []
    for clusters in (40, 160):
        centres = rng.normal(size=(clusters, 16))
        x = np.repeat(centres, 25, axis=0) + rng.normal(scale=0.03, size=(clusters * 25, 16))
        near = similarity.nearest_neighbours(vectors(spark, list(range(len(x))), x), 3, chunk_rows=50)
        got = {(r.src, r["rank"]): r.dst for r in near.collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        sims = unit @ unit.T
        np.fill_diagonal(sims, -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
        assert all(got[i, j + 1] == best[i, j] for i in range(len(x)) for j in range(3))
        visited.append(asked[-1] * 50)
    n = 40 * 25
    assert visited[0] < 0.6 * n * n and visited[1] < 0.35 * (4 * n) ** 2
    assert visited[1] < 4**1.7 * visited[0]


@pytest.mark.parametrize("signed", [False, True])
def test_rows_travel_once_a_shelf_not_once_a_chunk(spark, monkeypatch, signed):
    """Vectors without near ones: every chunk has to be looked at, but a row goes only where a shelf of them lies."""
    plain, asked = similarity.settle, []

    def watch(df):
        out = plain(df)
        if "split" in df.columns:
            asked.append((out.count(), out.agg(F.max(F.length("vec"))).first()[0] if dict(df.dtypes)["vec"] == "binary" else None))
        return out

    monkeypatch.setattr(similarity, "settle", watch)
    monkeypatch.setattr(similarity, "MIN_BLOCK_ROWS", 30)
    monkeypatch.setattr(similarity, "TASK_BYTES", 30 * 8 * 64)
    monkeypatch.setattr(similarity, "SHELF_BYTES", 150 * 8 * 64, raising=False)
    monkeypatch.setattr(similarity, "block_rows", lambda n, dims, cores: n)
    monkeypatch.setattr(similarity, "STEP_CELLS", 3_000)
    rng = np.random.default_rng(11)
    x = np.zeros((600, 64), np.float32)
    for row in x:
        row[rng.choice(64, 5, replace=False)] = rng.normal(size=5) if signed else rng.uniform(0.5, 2, size=5)
    got = {}
    near = similarity.nearest_neighbours(vectors(spark, list(range(600)), x), 3, min_sim=0.3)
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == {i: v for i, v in brute_force(list(range(600)), x.astype(np.float64), 3, 0.3).items() if v}
    rows, longest = asked[-1]
    assert rows <= 8 * 600  # at least 20 chunks
    assert longest == 5 * 8  # and only the places that are not zero


def test_rows_pack_to_bytes_and_back():
    x = np.float32([[0, 0, 0, 0, 0], [0, 0, 3, 0, 0], [1, 2, 3, 4, 5], [0, -1, 0, 0, np.nan]])
    packed = similarity._pack(x)
    assert [len(p) for p in packed] == [0, 8, 20, 16]
    assert np.array_equal(similarity._unpack(pd.Series(packed), 5, "<f4"), x, equal_nan=True)


def test_search_and_components_keep_no_copies_of_finished_steps(spark, monkeypatch):
    kept, gone = [], []
    monkeypatch.setattr(similarity, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    forget = similarity.forget
    monkeypatch.setattr(similarity, "forget", lambda df: gone.append(df) or forget(df))

    def file(df):
        return pathlib.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:"))

    vectors = spark.createDataFrame([(k, [math.cos(k / 9), math.sin(k / 9)]) for k in range(50)], "vec_id long, embedding array<double>")
    near = similarity.nearest_neighbours(vectors, 3, chunk_rows=8)
    files = [file(df) for df in kept]
    assert len(gone) == 2 and [f.exists() for f in files].count(False) == 2
    parts = similarity.connected_components(similarity.mutual_edges(near, 0.9))
    assert parts.count() == 50 and parts.select("component").distinct().count() == 1
    rounds = [file(df) for df in kept[len(files) :]]
    assert len(rounds) > 2 and [f.exists() for f in rounds] == [False] * (len(rounds) - 1) + [True]
