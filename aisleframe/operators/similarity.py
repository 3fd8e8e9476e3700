"""Exact nearest-neighbour join, mutual edges and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.functions.sampling import first_k_per_group, sample_rows
from aisleframe.session import forget, settle

MIN_BLOCK_ROWS = 4096
BLOCK_BYTES = 128 * 1024 * 1024  # one side of a block, held as doubles
TASK_BYTES = 24 * 1024 * 1024  # the same for a search, whose tasks hold several copies of both sides
STEP_CELLS = 4_000_000  # similarities that a task holds at a time
SHELF_BYTES = 96 * 1024 * 1024  # vectors that travel together, several chunks of them, as doubles
TILE_ROWS = 16  # near vectors of a chunk that one box is drawn around
OPEN_SHARE = 0.25  # of the pairs of rows and tiles; with more left open, tiles are not worth telling apart
MAX_PIVOTS = 256
EDGES_A_PART = 500_000  # edges of a graph in one partition between two rounds
SLACK = 1e-6  # radians, covers rounding of angles


def _angles(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1.0, 1.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero."""
    x = x.astype(np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _unit_rows(column: pd.Series) -> np.ndarray:
    return _unit(_matrix(column))


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: (place, value) pairs where that is shorter than the whole row."""
    row, at = np.nonzero(x)
    pairs = np.empty(len(row), [("at", "<u4"), ("value", x.dtype)])
    pairs["at"], pairs["value"] = at, x[row, at]
    ends = np.cumsum(np.bincount(row, minlength=len(x)))
    whole = x.shape[1] * x.itemsize
    out = []
    for i, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        out.append(pairs[lo:hi].tobytes() if (hi - lo) * pairs.itemsize < whole else x[i].tobytes())
    return out


def _unpack(column: pd.Series, dims: int, kind: str) -> np.ndarray:
    """The rows that ``_pack`` made bytes of; pairs are always shorter than a whole row."""
    packed = column.to_numpy()
    sizes = np.array([len(p) for p in packed], np.int64)
    x = np.zeros((len(packed), dims), kind)
    full = sizes == dims * x.itemsize
    x[full] = np.frombuffer(b"".join(packed[full]), kind).reshape(-1, dims)
    pairs = np.frombuffer(b"".join(packed[~full]), [("at", "<u4"), ("value", kind)])
    x[np.repeat(np.flatnonzero(~full), sizes[~full] // pairs.itemsize), pairs["at"]] = pairs["value"]
    return x


def block_rows(n: int, dims: int, cores: int) -> int:
    """Rows per side of a block.

    Every vector is sent to each block row and column it meets, so the shuffle
    shrinks as blocks grow: as large as memory allows, but small enough that
    the blocks outnumber the cores.
    """
    fits = max(1, BLOCK_BYTES // (8 * max(1, dims)))
    shared = int(n / np.ceil(np.sqrt(2 * max(1, cores))))
    return int(min(fits, max(MIN_BLOCK_ROWS, shared)))


def _first_k(row: np.ndarray, sim: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of every row, by row; ties go to the smaller rank."""
    best = np.lexsort((rank, -sim, row))
    ordered = row[best]
    return best[np.arange(len(best)) - np.searchsorted(ordered, ordered) < k]


def _top_k(q_ids, q, t_ids, t, rank, k: int, least: np.ndarray):
    """(query, target, similarity): places of the best ``k`` targets per query, never the query itself."""
    out = []
    step = max(1, STEP_CELLS // max(1, len(t_ids)))
    for lo in range(0, len(q_ids), step):
        sims = q[lo : lo + step] @ t.T
        sims[q_ids[lo : lo + step, None] == t_ids[None, :]] = -np.inf
        floor = least[lo : lo + step]
        if sims.shape[1] > k:
            floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
        row, col = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
        sim = sims[row, col]
        keep = _first_k(row, sim, rank[col], k)
        out.append((lo + row[keep], col[keep], sim[keep]))
    return [np.concatenate(parts) for parts in zip(*out)]


def _slack(dims: int) -> float:
    """More than singles can be wrong by in a similarity and in a bound of one, together."""
    return (dims + 8) * 2.0**-22


def _near_order(x: np.ndarray) -> np.ndarray:
    """Order of rows that keeps near ones together: halves along the line between two means, down to a tile."""
    order, open_ = np.arange(len(x)), [(0, len(x))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= TILE_ROWS:
            continue
        rows = order[lo:hi]
        some = x[rows[:: max(1, len(rows) // 1024)]]
        a = some[np.argmin(some @ some[0])]
        b = some[np.argmin(some @ a)]
        for _ in range(3):
            side = some @ a > some @ b
            if side.all() or not side.any():
                break
            a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
        # Whole tiles go left, so that only the last one is short.
        half = -(-len(rows) // (2 * TILE_ROWS)) * TILE_ROWS
        order[lo:hi] = rows[np.argpartition(x[rows] @ (a - b), half)]
        open_ += [(lo, lo + half), (lo + half, hi)]
    return order


def _search(q_ids, q, least, seen, t_ids, t, t_chunk, k: int, min_sim: float):
    """(query, target, similarity): places of the best ``k`` targets per query among the chunks it has to see.

    Targets lie in near order, chunk by chunk. No similarity with a row of a
    tile is above the one with the tile's box, the sum over all places of the
    larger product; tiles whose box stays below what a query has already are
    left out for it. ``least`` is what a similarity in singles must reach, with
    room for rounding; what is found that way is measured again in doubles.
    """
    dims = q.shape[1]
    slack = _slack(dims)
    q_length, t_length = (np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True) for x in (q, t))
    for length in (q_length, t_length):
        length[length == 0] = 1.0
    qs, ts = (np.divide(x, n).astype(np.float32) for x, n in ((q, q_length), (t, t_length)))
    rank = np.empty(len(t_ids), np.int64)
    rank[np.argsort(t_ids, kind="stable")] = np.arange(len(t_ids))
    inside = np.arange(len(t_chunk)) - np.searchsorted(t_chunk, t_chunk)
    first = np.flatnonzero(inside % TILE_ROWS == 0)
    last = np.append(first[1:], len(t_chunk))
    signed = bool((qs < 0).any())
    up, down = (np.maximum(qs, 0), np.minimum(qs, 0)) if signed else (qs, qs)
    # A short tile repeats its last row.
    tiles = np.minimum(first[:, None] + np.arange(TILE_ROWS), last[:, None] - 1)
    high, low = np.empty((2, len(first), dims), np.float32)
    some = max(1, STEP_CELLS // (TILE_ROWS * dims))
    for a in range(0, len(first), some):
        rows = ts[tiles[a : a + some]]
        high[a : a + some] = np.fmax.reduce(rows, axis=1)
        if signed:
            low[a : a + some] = np.fmin.reduce(rows, axis=1)
    least = least.astype(np.float32)
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def take(row, col, sim):
        """Merges exact similarities into the best so far."""
        nonlocal best
        row, col, sim = (np.concatenate(x) for x in zip(best, (row, col, sim)))
        keep = _first_k(row, sim, rank[col], k)
        best = [row[keep], col[keep], sim[keep]]
        full = np.flatnonzero(np.arange(len(keep)) - np.searchsorted(best[0], best[0]) == k - 1)
        at = best[0][full]
        least[at] = np.maximum(least[at], best[2][full] - slack)

    def measure():
        """Similarities in doubles of the pairs that wait."""
        if not waiting:
            return
        row, col = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        other = q_ids[row] != t_ids[col]
        row, col = row[other], col[other]
        sim = np.empty(len(row))
        step = max(1, STEP_CELLS // dims)
        for lo in range(0, len(row), step):
            r, c = row[lo : lo + step], col[lo : lo + step]
            sim[lo : lo + step] = np.einsum("ij,ij->i", q[r] / q_length[r], t[c] / t_length[c])
        near = sim >= min_sim
        take(row[near], col[near], sim[near])

    wide = max(1, STEP_CELLS // max(1, len(q_ids)))
    for a in range(0, len(first), wide):
        b = min(a + wide, len(first))
        bound = high[a:b] @ up.T
        if signed:
            bound += low[a:b] @ down.T
        open_ = (bound >= least) & seen[:, t_chunk[first[a:b]]].T
        if open_.mean() > OPEN_SHARE:
            rows, part = np.flatnonzero(open_.any(axis=0)), slice(first[a], last[b - 1])
            right = t[part] / t_length[part]
            step = max(1, STEP_CELLS // max(len(right), dims))
            for lo in range(0, len(rows), step):
                r = rows[lo : lo + step]
                floor = np.full(len(r), min_sim)
                row, col, sim = _top_k(q_ids[r], q[r] / q_length[r], t_ids[part], right, rank[part], k, floor)
                take(r[row], col + first[a], sim)
            continue
        for j in range(a, b):
            rows = np.flatnonzero(open_[j - a])
            if len(rows) == 0:
                continue
            row, col = np.nonzero(qs[rows] @ ts[first[j] : last[j]].T >= least[rows, None])
            waiting.append((rows[row], col + first[j]))
        if sum(len(w[0]) for w in waiting) > STEP_CELLS // 16:
            measure()
    measure()
    return best


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, angle) of the pivot nearest to each unit row."""
    angles = _angles(x @ pivots.T)
    home = angles.argmin(axis=1)
    return home, angles[np.arange(len(x)), home]


def _outside(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far a row surely is from everything in a cell: angles to the pivot against those of the cell's own rows."""
    return np.maximum(angles - high, low - angles)


def nearest_distinct(
    distinct: DataFrame, k: int, min_sim: float, seed: int = 42, chunk_rows: int | None = None
) -> DataFrame:
    """(rep, nb, sim): the ``k`` nearest others of each distinct vector, by cosine.

    Pivots make cells, and a cell of more than ``chunk_rows`` vectors is cut
    around pivots of its own into leaves, each with the range of its angles;
    only leaves that are still larger are dealt out by hash. A first pass inside
    a vector's own chunk bounds how far its k-th neighbour can be. By the
    triangle inequality on angles it then visits only cells, and in them only
    leaves, that can hold something closer. Chunks travel in shelves, packed, and
    only where a visitor waits; there boxes around a few near vectors rule out
    most of what the angles leave. Blocks emit at most ``k`` rows per visitor.
    The pivots, one for ``chunk_rows`` vectors and up to MAX_PIVOTS more, are
    what the driver holds. Vectors without structure visit every chunk: that is
    the cost of an exact search among them.
    """
    spark = distinct.sparkSession
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n = size["n"]
    dims = size["dims"] or 1
    shared = block_rows(n, dims, spark.sparkContext.defaultParallelism)
    shelf_rows = chunk_rows or min(shared, max(MIN_BLOCK_ROWS, SHELF_BYTES // (8 * max(1, dims))))
    chunk_rows = chunk_rows or min(shared, max(MIN_BLOCK_ROWS, TASK_BYTES // (8 * max(1, dims))))
    n_pivots = int(min(MAX_PIVOTS, max(1, -(-n // chunk_rows))))
    id_type, vec_type = (dict(distinct.dtypes)[c] for c in ("rep", "vec"))
    kind = "<f4" if vec_type == "array<float>" else "<f8"
    picked = [r["vec"] for r in sample_rows(distinct, n_pivots, ["rep"], seed).select("vec").collect()]
    pivots = _unit_rows(pd.Series(picked)) if picked else np.zeros((1, 1))
    reach = float(_angles(np.array([min_sim]))[0]) if min_sim > -1.0 else np.pi

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                home, angle = _nearest(_unit_rows(pdf["vec"]), pivots)
                packed = _pack(_matrix(pdf["vec"]).astype(kind))
                yield pd.DataFrame({"rep": pdf["rep"], "vec": packed, "cell": home, "angle": angle})

    placed = settle(
        distinct.select("rep", "vec").mapInPandas(assign, f"rep {id_type}, vec binary, cell int, angle double")
    )
    # At most MAX_PIVOTS rows.
    copies = [placed]
    cells = {
        r["cell"]: r
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    }
    inner = _inner_pivots(placed, {c: -(-r["n"] // chunk_rows) for c, r in cells.items()}, seed, dims, kind)
    first_leaf, total_leaves = {}, 0
    for c in sorted(cells):
        first_leaf[c] = total_leaves
        total_leaves += len(inner.get(c, [0]))

    def settle_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            leaf = pdf["cell"].map(first_leaf).to_numpy(np.int64).copy()
            own = pdf["angle"].to_numpy().copy()
            for c in set(pdf["cell"]) & set(inner):
                rows = np.nonzero((pdf["cell"] == c).to_numpy())[0]
                home, angle = _nearest(_unit(_unpack(pdf["vec"].iloc[rows], dims, kind)), inner[c])
                leaf[rows] += home
                own[rows] = angle
            yield pd.DataFrame({"rep": pdf["rep"], "vec": pdf["vec"], "leaf": leaf, "own": own})

    with_leaf = placed.mapInPandas(settle_in, f"rep {id_type}, vec binary, leaf int, own double")
    if inner:
        placed = settle(with_leaf)
        copies.append(placed)
        # A row a leaf.
        spans = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        leaves = {r["leaf"]: r for r in spans.collect()}
    else:
        # Every cell is one leaf, and its figures are known.
        placed, leaves = with_leaf, {first_leaf[c]: r for c, r in cells.items()}
    chunks_of, total = {}, 0
    shelf_of: list[int] = []  # of each chunk
    on_shelf = 0
    for leaf in sorted(leaves):
        chunks_of[leaf] = np.arange(total, total + -(-leaves[leaf]["n"] // chunk_rows))
        total += len(chunks_of[leaf])
        rows = leaves[leaf]["n"] / len(chunks_of[leaf])
        for _ in chunks_of[leaf]:
            new = not shelf_of or on_shelf + rows > shelf_rows
            shelf_of.append((shelf_of[-1] + 1 if shelf_of else 0) if new else shelf_of[-1])
            on_shelf = rows if new else on_shelf + rows
    first_chunk = np.flatnonzero(np.diff(shelf_of, prepend=-1))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mine = [chunks_of[leaf] for leaf in pdf["leaf"]]
            chunk = [c[h % len(c)] for c, h in zip(mine, pdf["h"])]
            yield pd.DataFrame({"rep": pdf["rep"], "vec": pdf["vec"], "chunk": chunk})

    placed = placed.withColumn("h", F.xxhash64("rep")).mapInPandas(number, f"rep {id_type}, vec binary, chunk int")

    cell_ids = np.array(sorted(cells))
    lows, highs = (np.array([cells[c][x] for c in cell_ids]) for x in ("lo", "hi"))

    def plan_visits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = _unit(_unpack(pdf["vec"], dims, kind))
        thin = x.astype(np.float32)
        least = np.full(len(pdf), min_sim)
        if len(pdf) > k:
            step = max(1, STEP_CELLS // len(pdf))
            for lo in range(0, len(pdf), step):
                sims = thin[lo : lo + step] @ thin.T
                rows = np.arange(len(sims))
                sims[rows, lo + rows] = -np.inf
                sims.partition(sims.shape[1] - k, axis=1)
                least[lo : lo + step] = np.maximum(least[lo : lo + step], sims[:, -k])
        least -= _slack(dims)
        radius = np.minimum(reach, _angles(least)) + SLACK
        near = _outside(_angles(x @ pivots[cell_ids].T), lows, highs) <= radius[:, None]
        # A byte for every row and chunk.
        visits = np.zeros((len(pdf), total), bool)
        for j, c in enumerate(cell_ids):
            rows = np.nonzero(near[:, j])[0]
            mine = [k for k in range(first_leaf[c], first_leaf[c] + len(inner.get(c, [0]))) if k in leaves]
            if c in inner and len(rows):
                low, high = (np.array([leaves[k][x] for k in mine]) for x in ("lo", "hi"))
                centre = inner[c][[k - first_leaf[c] for k in mine]]
                open_ = _outside(_angles(x[rows] @ centre.T), low, high) <= radius[rows, None]
            else:
                open_ = np.ones((len(rows), len(mine)), bool)
            for m, leaf in enumerate(mine):
                visits[np.ix_(rows[open_[:, m]], chunks_of[leaf])] = True
        shelves = np.logical_or.reduceat(visits, first_chunk, axis=1)
        to = np.nonzero(shelves)[1].astype(np.int32)
        place = np.empty(len(pdf), np.int64)
        place[_near_order(thin)] = np.arange(len(pdf))
        return pd.DataFrame(
            {
                "rep": pdf["rep"],
                "vec": pdf["vec"],
                "chunk": pdf["chunk"],
                "place": place,
                "least": least,
                "seen": [bits.tobytes() for bits in np.packbits(visits, axis=1)],
                "split": shelf_of[pdf["chunk"].iloc[0]],
                "shelves": np.split(to, np.cumsum(shelves.sum(axis=1))[:-1]),
            }
        )

    planned = settle(
        placed.groupBy("chunk").applyInPandas(
            plan_visits,
            f"rep {id_type}, vec binary, chunk int, place int, least double, seen binary, split int, shelves array<int>",
        )
    )
    for copy in copies:
        forget(copy)
    asks = settle(planned.select("rep", "vec", "least", "seen", "split", F.explode("shelves").alias("shelf")))
    # A shelf goes to the splits that hold a visitor of it.
    waiting = asks.select(F.col("shelf").alias("_to"), F.col("split").alias("part")).distinct()
    targets = planned.join(waiting, F.col("split") == F.col("_to")).select(
        F.col("rep").alias("nb"), F.col("vec").alias("other"), "chunk", "place", F.col("_to").alias("shelf"), "part"
    )

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"rep": left["rep"].iloc[:0], "nb": left["rep"].iloc[:0], "sim": np.empty(0)})
        right = right.sort_values(["chunk", "place"])
        bits = np.frombuffer(b"".join(left["seen"]), np.uint8).reshape(len(left), -1)
        seen = np.unpackbits(bits, axis=1, count=total).astype(bool)
        q_ids, t_ids = left["rep"].to_numpy(), right["nb"].to_numpy()
        q, t = (_unpack(column, dims, kind) for column in (left["vec"], right["other"]))
        row, col, sim = _search(
            q_ids, q, left["least"].to_numpy(), seen, t_ids, t, right["chunk"].to_numpy(), k, min_sim
        )
        return pd.DataFrame({"rep": q_ids[row], "nb": t_ids[col], "sim": sim})

    found = (
        asks.groupBy("shelf", "split")
        .cogroup(targets.groupBy("shelf", "part"))
        .applyInPandas(block, f"rep {id_type}, nb {id_type}, sim double")
    )
    return first_k_per_group(found, ["rep"], [F.col("sim").desc(), F.col("nb").asc()], k)


def _inner_pivots(placed: DataFrame, wanted: dict[int, int], seed: int, dims: int, kind: str) -> dict[int, np.ndarray]:
    """Unit vectors drawn by hash in each cell that needs more than one chunk, as many as it needs."""
    large = {c: m for c, m in wanted.items() if m > 1}
    if not large:
        return {}
    mine = placed.filter(F.col("cell").isin(list(large))).withColumn("_h", F.xxhash64(F.lit(seed), "rep"))
    drawn = first_k_per_group(mine, ["cell"], [F.col("_h").asc(), F.col("rep").asc()], max(large.values()))
    out: dict[int, list] = {}
    for r in drawn.select("cell", "vec").collect():
        out.setdefault(r["cell"], []).append(r["vec"])
    return {c: _unit(_unpack(pd.Series(v[: large[c]]), dims, kind)) for c, v in out.items()}


def nearest_neighbours(
    vectors: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    min_sim: float = -1.0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """(src, dst, sim, rank): exact cosine top-k of every row, self excluded.

    Order is similarity first, then the smaller id. Equal vectors are compared
    once: only the k + 1 smallest ids of a set of copies can be a neighbour of
    anything, so a huge set of copies stays small.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    members = (
        first_k_per_group(rows, ["vec"], [F.col("id").asc()], k + 1)
        .groupBy("vec")
        .agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members"))
    )
    distinct = settle(members)
    near = nearest_distinct(distinct, k, min_sim, chunk_rows=chunk_rows)
    other = near.join(distinct.select(F.col("rep").alias("nb"), "members"), "nb").select(
        "rep", F.explode("members").alias("dst"), "sim"
    )
    # A row's own copies are its nearest neighbours; alone, it only finds itself.
    own = distinct.select("rep", F.explode("members").alias("dst"), F.lit(1.0).alias("sim"))
    ranked = first_k_per_group(
        other.unionByName(own), ["rep"], [F.col("sim").desc(), F.col("dst").asc()], k + 1
    )
    lists = ranked.groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "dst"))).alias("near")
    )
    by_id = rows.join(distinct.select("vec", "rep"), "vec").select("id", "rep").join(lists, "rep")
    mine = F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k)
    return by_id.select(F.col("id").alias("src"), F.posexplode(mine).alias("pos", "e")).select(
        "src", F.col("e.dst").alias("dst"), (-F.col("e.neg")).alias("sim"), (F.col("pos") + 1).alias("rank")
    )


def mutual_edges(neighbours: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, sim) with src < dst where each is among the other's neighbours.

    Both directions meet in one aggregation; no self-join is needed.
    """
    return (
        neighbours.filter(F.col("sim") >= threshold)
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.count("*").alias("_n"), F.max("sim").alias("sim"))
        .filter("_n = 2")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _few_parts(edges: DataFrame, n: int) -> DataFrame:
    """``n`` edges in as many partitions as they are worth, or one a core."""
    return edges.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, n // EDGES_A_PART))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every node of an edge; the component is its smallest id.

    Alternates a large-star and a small-star step (Kiveris et al., 2014) until
    every node hangs off the smallest one. Minima are aggregated before the
    join, so a node with very many edges has one row on the build side. What is
    left of few edges lies in few partitions, so that a round has no more tasks
    to read it than it is worth.
    """
    e = settle(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    )
    before, kept = _fingerprint(e), e
    e = _few_parts(e, before[0])
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, kept = kept, settle(_few_parts(moved.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), before[0]))
        forget(last)
        e = kept
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
