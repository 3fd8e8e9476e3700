"""SimHash near-duplicates with generalised pigeonhole candidates.

A fingerprint of ``bits`` bits is cut into partitions of correlated bits. Each
fingerprint gets a threshold per partition that sum to ``distance - partitions
+ 1``; whatever lies within ``distance`` of it then agrees with it in some
partition within that partition's threshold (-1 leaves a partition out).
A dynamic programme picks the thresholds with the fewest expected candidates
from exact counts of the partition values. Each fingerprint probes the values
within its thresholds, and what it finds is verified.

Partition values that many fingerprints share would give pairs without end.
Their members are linked through mid-points instead: each emits itself and all
its one-bit neighbours, and whoever emits the same value lies within two bits.
That is exact, takes a fixed number of rows per member and needs no pairs.

Nulls: a null text is an empty one, whose fingerprint is zero and is linked
like any other. A null id is carried and is never a component's smallest id
unless all are null. Repeated rows fall into one component. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.llm.common import Scratch, document_key, flagged, fresh, key_map, settle, stored, without
from aisleframe.operators.similarity import connected_components

#: Partition values with more fingerprints than this are linked through mid-points.
PAIRED_AT_MOST = 32
UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Texts of a value that lead in the first round of the near-duplicate stage. Fingerprints have joined the nearest by then.
FIRST_LEADERS = 32
#: Bits of the parity that rules out candidates, and of the cells in which shingles are counted to order them.
PARITY, SKETCH_BITS = 1024, 20
#: Odd multipliers that spread one 64-bit hash over further words of a wide fingerprint.
MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased (A-Z) text, repeats included."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    flat = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(flat, seed)], np.uint64)
    ends, starts, at = [], [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
        ends.append(at)
        at += 1
    return np.fromiter(
        (xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(parts) - words + 1
    )


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit values: the hash itself, then mixes of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    with np.errstate(over="ignore"):
        for j in range(1, words):
            x = (h ^ np.uint64((j * MIX_B) & (2**64 - 1))) * np.uint64(MIX_A)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX_B)
            out[:, j] = x ^ (x >> np.uint64(32))
    return out


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of a text's hashes: bits set in over half of them."""
    if not len(h):
        return np.zeros(words, np.uint64)
    total = np.zeros(64 * words, np.int64)
    for part in np.array_split(h, len(h) // 20_000 + 1):
        bits = np.unpackbits(widened(part, words).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """(id, lanes): the fingerprint as ``lanes`` signed longs of 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py(), words), lanes).view(np.int64).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=[id_col, "lanes"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lanes array<long>")


def bit_groups(prints: DataFrame, lanes: int, per_lane: int) -> list[tuple[int, list[int]]]:
    """Cut each lane's 64 bits into ``per_lane`` groups of about equal size, correlated bits together.

    The joint counts of all bit pairs of a lane are summed over all
    fingerprints; the result is a 65 x 64 matrix a lane, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, n = np.zeros((lanes, 64, 64), np.int64), 0
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, lanes)
            for k in range(lanes):
                bits = np.unpackbits(v[:, k].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                joint[k] += (bits.T @ bits).astype(np.int64)
            n += len(v)
        rows = pa.array(range(65 * lanes), pa.int32())
        values = [row for k in range(lanes) for row in [*joint[k].tolist(), [n] * 64]]
        yield pa.RecordBatch.from_arrays([rows, pa.array(values, pa.list_(pa.int64()))], names=["row", "counts"])

    sums = prints.select("lanes").mapInArrow(run, "row int, counts array<long>").groupBy("row").agg(
        *[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(64)]
    )
    table = np.zeros((lanes, 65, 64))
    for r in sums.collect():
        table[r["row"] // 65, r["row"] % 65] = list(r)[1:]
    groups = []
    for lane in range(lanes):
        n = max(table[lane, 64, 0], 1.0)
        mean = np.diag(table[lane, :64]) / n
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        corr = np.abs(table[lane, :64] / n - np.outer(mean, mean)) / np.outer(spread, spread)
        left = set(range(64))
        for k in range(per_lane):
            size = len(left) // (per_lane - k)
            group: list[int] = []
            while len(group) < size:
                best = max(left, key=lambda b: (corr[b, group or list(left)].sum(), -b))
                group.append(best)
                left.discard(best)
            groups.append((lane, sorted(group)))
    return groups


def _cells(groups: list[tuple[int, list[int]]]):
    """mapInArrow body: (id, lanes) to (id, part, value), the bits of a group packed from bit 0 up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            for i, (lane, bits) in enumerate(groups):
                value = np.zeros(n, np.int64)
                for k, b in enumerate(bits):
                    value |= ((v[:, lane] >> np.int64(b)) & 1) << np.int64(k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, i, np.int32)), pa.array(value)], names=["id", "part", "value"]
                )

    return run


def allocate(counts: np.ndarray, widths: list[int], ways: np.ndarray, distance: int, top: int) -> np.ndarray:
    """Thresholds per fingerprint and partition, by dynamic programming.

    ``counts`` (n, parts) says how many fingerprints share each value. Going
    from -1 to t in a partition costs its expected candidates: the sharers, and
    for every flipped value the mean number of fingerprints per value
    (``ways``), plus one for the probe itself. No threshold is above ``top``.
    """
    from math import comb

    n, parts = counts.shape
    goal = distance - parts + 1
    span = goal + parts  # every partition gives -1 at least
    best = np.full((n, span + 1), np.inf)
    best[:, 0] = 0.0
    picks = np.zeros((parts, n, span + 1), np.int8)
    for i in range(parts):
        cost = [np.zeros(n)]
        for t in range(top + 1):
            flips = sum(comb(widths[i], r) for r in range(1, t + 1))
            cost.append(counts[:, i] + flips * (ways[i] + 1.0))
        new = np.full_like(best, np.inf)
        for t in range(-1, top + 1):
            moved = t + 1
            if moved > span:
                break
            with_t = best[:, : span + 1 - moved] + cost[moved][:, None]
            better = with_t < new[:, moved:]
            new[:, moved:] = np.where(better, with_t, new[:, moved:])
            picks[i][:, moved:] = np.where(better, t, picks[i][:, moved:])
        best = new
    out = np.empty((n, parts), np.int8)
    at = np.full(n, span)
    for i in reversed(range(parts)):
        out[:, i] = picks[i][np.arange(n), at]
        at = at - (out[:, i] + 1)
    return out


def flips(width: int, most: int) -> np.ndarray:
    """The masks of a partition with at most ``most`` bits set."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(width), r)], np.int64)


def probes(prints: DataFrame, lanes: int, per_lane: int, distance: int, top: int) -> tuple[DataFrame, DataFrame]:
    """Index and probes of (id, lanes), ids being distinct.

    The index is (id, part, value, n), n being the ids with that value; the
    probes are (id, part, value): every value within the id's thresholds. Two
    ids within ``distance`` bits meet: each one's probes find the other.
    """
    groups = bit_groups(prints, lanes, per_lane)
    widths, parts = [len(g) for _, g in groups], len(groups)
    index = stored(prints.select("id", "lanes").mapInArrow(_cells(groups), "id long, part int, value long"), "cells")
    sizes = stored(index.groupBy("part", "value").agg(F.count("*").alias("n")), "sizes")
    mean = {r["part"]: r["mean"] for r in sizes.groupBy("part").agg(F.avg("n").alias("mean")).collect()}
    # Expected fingerprints behind one flipped value: the mean over the values there are.
    ways = np.array([mean.get(i, 0.0) for i in range(parts)])
    counted = stored(index.join(sizes, ["part", "value"]).select("id", "part", "value", "n"), "counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(w, t): flips(w, t) for w in set(widths) for t in range(top + 1)}
        for batch in batches:
            ids = batch.column(0)
            cells = batch.column(1).flatten()
            n, value = (cells.field(k).to_numpy(zero_copy_only=False).reshape(-1, parts) for k in (1, 2))
            limits = allocate(n.astype(float), widths, ways, distance, top)
            for i in range(parts):
                for t in range(top + 1):
                    mine = np.flatnonzero(limits[:, i] == t)
                    if not len(mine):
                        continue
                    m = masks[widths[i], t]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(np.repeat(mine, len(m)))),
                            pa.array(np.full(len(mine) * len(m), i, np.int32)),
                            pa.array((value[mine, i][:, None] ^ m[None, :]).ravel()),
                        ],
                        names=["id", "part", "value"],
                    )

    per_id = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "value"))).alias("cells"))
    return counted, per_id.mapInArrow(run, "id long, part int, value long")


def links(fps: DataFrame, distance: int = 2, parts: int = 4) -> DataFrame:
    """(src, dst) over distinct values ``fp``: edges that connect exactly the
    fingerprints connected by steps of at most ``distance`` differing bits.

    Inside a value shared by few fingerprints every near pair is an edge.
    Members of a crowded value get edges through mid-points, exact for a
    distance of two; for other distances every value is paired.
    """
    prints = fps.select(F.col("fp").alias("id"), F.array("fp").alias("lanes"))
    counted, asked = probes(prints, 1, parts, distance, distance)
    crowd = PAIRED_AT_MOST if distance == 2 else 2**62
    asked = asked.withColumnRenamed("id", "src")
    small = counted.filter(F.col("n") <= crowd).select(F.col("id").alias("dst"), "part", "value")
    apart = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    pairs = asked.join(small, ["part", "value"]).filter((F.col("src") != F.col("dst")) & (apart <= distance))
    pairs = pairs.select("src", "dst")
    if distance != 2:
        return pairs.distinct()
    middle = F.transform(
        F.sequence(F.lit(-1), F.lit(63)),
        lambda b: F.when(b < 0, F.col("src")).otherwise(
            F.col("src").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
        ),
    )
    # A probe may reach a crowded value by flipping bits, so its prober emits too.
    crowded = counted.filter(F.col("n") > crowd)
    members = asked.join(crowded.select("part", "value").distinct(), ["part", "value"]).select("src")
    members = members.unionByName(crowded.select(F.col("id").alias("src"))).distinct()
    stars = members.select("src", F.explode(middle).alias("middle"))
    hubs = stars.groupBy("middle").agg(F.min("src").alias("dst"), F.max("src").alias("_last")).filter("dst < _last")
    through = stars.join(hubs, "middle").filter(F.col("src") != F.col("dst")).select("src", "dst")
    return pairs.unionByName(through).distinct()


def components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, parts: int = 4
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every document."""
    prints = settle(fingerprints(docs, id_col, text, words).select(id_col, F.col("lanes")[0].alias("fp")))
    owners = settle(prints.groupBy("fp").agg(F.min(id_col).alias("_first")))
    joined = connected_components(links(owners.select("fp"), distance, parts))
    roots = owners.join(joined.withColumnRenamed("id", "fp"), "fp")
    smallest = roots.groupBy("component").agg(F.min("_first").alias("component_id"))
    # Only values with a link take part in the second join; others keep their own smallest id.
    linked = roots.join(smallest, "component").select("fp", "component_id")
    label = owners.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "_first").alias("component_id"))
    return prints.join(label, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _set_rows(docs: DataFrame, key: str, text: str, words: int, schema: str, row) -> DataFrame:
    """(id, what ``row`` makes of the text's shingle set), ``schema`` naming the columns after the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in schema.split(", ")))
        types = [pa.int64() if k == "long" else pa.list_(pa.int64()) for k in kinds]
        for batch in batches:
            rows = [row(np.unique(shingle_hashes(t.as_py(), words))) for t in batch.column(1)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, {schema}")


def _set_name(shingles: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh64_intdigest

    data = shingles.tobytes()
    return tuple(int(v) for v in np.array([xxh64_intdigest(data, k) for k in (1, 2)], np.uint64).view(np.int64))


def _parity(shingles: np.ndarray) -> list[int]:
    """``PARITY`` bits, each the parity of the shingles that fall on it. Two sets differ in as many shingles at least as bits."""
    hits = np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def shingle_sketch(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many texts have a shingle in each of 2 ** SKETCH_BITS hash cells: it orders shingles, and no result depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2**SKETCH_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                at = (np.unique(shingle_hashes(t.as_py(), words)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(cells, at, 1)
        blocks = cells.astype(np.int32).reshape(-1, 2048)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([b.tobytes() for b in blocks[some]], pa.binary())], names=["block", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int32).astype(np.int64) for b in rows.column("counts"))
        return pa.table([rows.column("block")[:1], pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["block", "counts"])

    sums = docs.select(text).mapInArrow(run, "block long, counts binary").groupBy("block").applyInArrow(add, "block long, counts binary")
    out = np.zeros((2**SKETCH_BITS // 2048, 2048), np.int32)
    for r in sums.toLocalIterator():
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.int32)
    return out.reshape(-1)


HEAD = "h1 long, h2 long, size long, fp long, parity array<long>, first array<long>"


def set_heads(docs: DataFrame, key: str, text: str, similarity: float, words: int, sketch: np.ndarray) -> DataFrame:
    """(id, name of the shingle set, its size, its fingerprint, its parity, the shingles it meets others by) of every document.

    In any common order of all shingles, two sets of that Jaccard similarity
    share one of their first ``n - ceil(similarity * n) + 1`` shingles. The
    order is the rare ones first, by ``sketch``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def head(shingles: np.ndarray):
        n = len(shingles)
        order = np.lexsort((shingles, shared.value[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
        first = order[: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else order
        return *_set_name(shingles), n, int(majority(shingles).view(np.int64)[0]), _parity(shingles), shingles[first].view(np.int64).tolist()

    return _set_rows(docs, key, text, words, HEAD, head)


def simhash_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(id, to), id above to: sets whose fingerprints link at ``distance`` or fewer differing bits.

    The first set of a fingerprint stands for it: the other sets with that
    fingerprint pair with it, and linked fingerprints give one pair each.
    """
    owners = settle(prints.groupBy("fp").agg(F.min("id").alias("to")))
    same = prints.select("id", "fp").join(owners, "fp").select("id", "to")
    at = owners.select(F.col("fp").alias("src"), F.col("to").alias("id"))
    linked = links(owners.select("fp"), distance).join(at, "src").join(owners.withColumnRenamed("fp", "dst"), "dst").select("id", "to")
    return same.unionByName(linked).filter("id <> to").select(F.greatest("id", "to").alias("id"), F.least("id", "to").alias("to")).distinct()


def near_links(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(id, component) of all sets in the graph of the pairs with a Jaccard similarity of ``similarity``
    or more, as far as they have a partner.

    ``prints`` has the heads of the sets by distinct ids; ``sets_of`` gives the
    whole sets (id, shingles) of the ids in a table. The pairs whose SimHash
    fingerprints link (see ``simhash_pairs``) come first; those that are near
    are joined. A fingerprint tells near sets apart by chance, so what is not
    in one component by then is met by its rare shingles, where candidates are
    exact (see ``set_heads``). Of the texts with such a value the first ones lead; all
    others of another component are compared with them, components are joined,
    and the next leaders, more each time, follow until each value's texts are
    in one component or have all been compared. The tables of a round go with it.
    """
    by_value = Window.partitionBy("value").orderBy("pos", "id")
    with Scratch(prints.sparkSession) as keep:
        index = prints.select("id", "size", F.posexplode("first").alias("pos", "value"))
        index = index.withColumn("rank", F.row_number().over(by_value)).withColumn("_next", F.lead("id").over(by_value))
        todo = keep(index.filter("rank > 1 OR _next IS NOT NULL").drop("_next").withColumn("comp", F.col("id")), "index")
        differing = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        joined: DataFrame | None = None

        def able(met: DataFrame) -> DataFrame:
            """The pairs whose sizes and parities do not rule them out."""
            for key, bits, n in (("id", "a", "n"), ("to", "b", "m")):
                met = met.join(prints.select(F.col("id").alias(key), F.col("parity").alias(bits), F.col("size").alias(n)), key)
            differ_most = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
            return keep(met.filter(differing <= differ_most).select("id", "to"), "near")

        def join_near(near: DataFrame) -> None:
            """Verify the pairs on whole sets and join the components of those that are near."""
            nonlocal joined
            involved = keep(near.select("id").unionByName(near.select(F.col("to").alias("id"))).distinct(), "involved")
            sets = keep(sets_of(involved), "sets")
            both = F.size(F.array_intersect("a", "b"))
            found = keep(
                near.join(sets.select("id", F.col("shingles").alias("a")), "id")
                .join(sets.select(F.col("id").alias("to"), F.col("shingles").alias("b")), "to")
                .filter(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9)
                .select(F.col("id").alias("src"), F.col("to").alias("dst")),
                "found",
            )
            # Of the pairs of earlier rounds only who hangs together counts: a link from each to the first.
            edges = found if joined is None else found.unionByName(joined.filter("id <> component").select(F.col("id").alias("src"), F.col("component").alias("dst")))
            before, joined = joined, keep(connected_components(edges), "components")
            keep.drop(before, involved, sets, found)

        def open_rows(rows: DataFrame) -> DataFrame:
            """The index rows with their components of now, of the values whose texts are not in one component."""
            if joined is not None:
                known = joined.select("id", F.col("component").alias("_comp"))
                rows = rows.join(known, "id", "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp")
            open_values = rows.groupBy("value").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high")
            return keep(rows.join(open_values.select("value"), "value", "left_semi").select(*todo.columns), "index")

        near = able(simhash_pairs(prints))
        if near.limit(1).count():
            join_near(near)
            before, todo = todo, open_rows(todo)
            keep.drop(before)
        keep.drop(near)
        done, take = 0, FIRST_LEADERS
        while todo.limit(1).count():
            heads = todo.filter(F.col("rank") <= done + take).select("value", *[F.col(c).alias(f"to_{c}") for c in ("id", "size", "pos", "rank", "comp")])
            # What two sets share at most when this is their first common shingle, and what they must share.
            most = F.least(F.col("size") - F.col("pos"), F.col("to_size") - F.col("to_pos"))
            least = similarity / (1 + similarity) * (F.col("size") + F.col("to_size")) - 1e-6
            met = (
                todo.join(heads.hint("merge"), "value")
                .filter((F.col("rank") > F.col("to_rank")) & (F.col("comp") != F.col("to_comp")) & (most >= least))
                .select(F.greatest("id", "to_id").alias("id"), F.least("id", "to_id").alias("to"))
                .distinct()
            )
            near = able(met)
            if near.limit(1).count():
                join_near(near)
            done, take = done + take, take * 32
            # Who has led has met all it can meet in that value.
            before, todo = todo, open_rows(todo.filter(F.col("rank") > done))
            keep.drop(before, near)
        if joined is None:
            return prints.sparkSession.createDataFrame([], "id long, component long")
        return stored(joined, "components")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The documents without those that hang together with an earlier one by near copies.

    SimHash fingerprints of the shingle sets bring the nearest texts together;
    exact sets verify them, and rare shingles find the pairs whose fingerprints
    lie further apart. Two documents are near when the Jaccard similarity of their sets of
    ``words``-word shingles is ``similarity`` or more. All such pairs count,
    also through documents that go, and of each connected group the first by id
    stays (null ids last). Documents that repeat in id and text stay or go
    together. Texts of one shingle set are one text, texts without a word too.
    """
    doc, place = fresh(docs, "_doc"), fresh(docs, "_place")
    keyed = docs.withColumn(doc, document_key(id_col, text))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(doc).alias("doc"))
    placed = keyed.select(order.alias(place), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as keep:
        # Two passes hash the texts: one to count shingles, one for all that is told of a set.
        sketch = shingle_sketch(docs, text, words)
        heads = keep(set_heads(placed, place, "text", similarity, words, sketch).withColumnRenamed("id", "place"), "heads")
        # Numbers that rise with the place stand for the distinct sets from here on.
        same = heads.groupBy("h1", "h2").agg(F.min("place").alias("place")).select("place")
        same = keep(
            same.repartitionByRange("place")
            .sortWithinPartitions("place")
            .select(F.monotonically_increasing_id().alias("id"), "place"),
            "texts",
        )
        prints = heads.filter("size > 0").join(same, "place").select("id", "size", "fp", "parity", "first").dropDuplicates(["id"])
        prints = keep(prints, "prints")

        def sets_of(ids: DataFrame) -> DataFrame:
            """Whole sets of some texts; the others are left where they lie."""
            wanted = same.join(ids, "id").select("id", F.col("place.doc").alias(doc))
            bits = key_map(wanted, F.col(doc)["a"])
            rows = flagged(keyed.select(doc, F.col(text).alias("text")), F.col(doc)["a"], bits, "_may").filter("_may")
            found = _set_rows(rows, doc, "text", words, "shingles array<long>", lambda s: (s.view(np.int64),))
            return found.withColumnRenamed("id", doc).join(wanted, doc).select("id", "shingles").dropDuplicates(["id"])

        joined = near_links(prints, sets_of, similarity)
        kept = same.join(joined.filter("id <> component").select("id"), "id", "left_anti").select("place")
        gone = stored(heads.select("place").join(kept, "place", "left_anti").select(F.col("place.doc").alias(doc)).distinct(), "gone")
    return without(keyed, doc, gone).select(*docs.columns)
