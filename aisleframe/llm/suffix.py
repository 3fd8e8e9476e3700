"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

A byte goes when a ``length``-byte string that covers it also starts anywhere
else, in the same document or another one. Three steps:

1. Anchors. Of the ``length // 2`` first positions of a window, the one with the
   least 8-byte hash is its anchor; it depends on the window's bytes alone, so
   equal windows have equal anchors at equal offsets and equal ``length // 2``
   bytes behind them (the key). Only keys seen twice can hold repeats.
2. Whole slices. An anchor's windows make one slice of text. A slice that is
   there twice, by a 128-bit BLAKE2b digest of its bytes, repeats whole; that is
   a count.
3. Suffix sort. What is left of a key, one of each different slice, is brought
   together. The suffixes that start at the same offset from the anchor are
   merge-sorted; two suffixes are compared by their common extension, found by
   binary search on prefix polynomial hashes. Neighbours in that order with a
   common extension of ``length`` repeat, which is verified byte by byte.

Slices of a key that are more than one task should sort are cut finer first:
windows whose offsets from the anchor lie in a shorter range share more bytes,
and those make the key of smaller slices, which go through steps 2 and 3. A
range of one offset has the whole window as its key, so that equal keys are
equal slices: this ends after log2(length) rounds at most, without a key too
large to sort. Keys only bring slices together, so their 64 bits decide nothing.

Documents are told by 128 bits of id and text. Texts may be of any length; a
task holds about 40 bytes per byte of the text it scans. Columns other than id
and text are not returned, whatever their names.

Nulls: a null text is empty. A null id is carried. Rows that repeat are
documents of their own, so each of them repeats the other. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Scratch, document_key, stored

#: Different slices of one key that are sorted together; beyond that they are cut finer.
SORTED_TOGETHER = 4_000
#: Odd base of the polynomial hashes.
BASE = 0x9E3779B97F4A7C15
#: Bytes of slices that are sorted in one go.
SORTED_BYTES = 1_000_000


def _digest(data: bytes, ahead: int) -> bytes:
    """What tells a slice: its bytes, and how far its first window is from the anchor."""
    return hashlib.blake2b(data, digest_size=16, salt=ahead.to_bytes(8, "little")).digest()


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def anchors_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for all windows of a text."""
    w, n = length // 2, len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    m = n + w - 1
    grams = np.ndarray((m,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = ((grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    # Hash above, position below: the minimum is the leftmost least hash.
    v = h << np.uint64(32) | np.arange(m, dtype=np.uint64)
    blocks = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:m] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(2**32 - 1)
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], turn))
    last = np.concatenate((turn, [n])) - 1
    return least[first].astype(np.int64), first, last


def _scan(length: int):
    """(doc, text) to (doc, anchor, lo, hi, key, sig)."""
    from xxhash import xxh64_intdigest

    half = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                docs, keys, sigs, places = [], [], [], []
                for doc, text in zip(batch.column(0)[part : part + 500].to_pylist(), batch.column(1)[part : part + 500].to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    found = anchors_of(data, length)
                    if not len(found[0]):
                        continue
                    for p, a, b in zip(*(c.tolist() for c in found)):
                        docs.append(doc)
                        keys.append(xxh64_intdigest(data[p : p + half]))
                        sigs.append(_digest(data[a : b + length], p - a))
                    places.append(found)
                if docs:
                    at, lo, hi = (pa.array(np.concatenate(c)) for c in zip(*places))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.binary()), at, lo, hi, pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sigs, pa.binary())],
                        names=["doc", "anchor", "lo", "hi", "key", "sig"],
                    )

    return run


def powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Prefixes:
    """Prefix polynomial hashes of a byte array, modulo 2**64 with an odd base."""

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data) + 1
        with np.errstate(over="ignore"):
            scale = powers_of(BASE, n)
            self.back = powers_of(pow(BASE, -1, 2**64), n)
            self.sums = np.zeros(n, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * scale[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b have equal hashes."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.back[a] == (self.sums[b + n] - self.sums[b]) * self.back[b]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension, ``most`` at the most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def below(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether the suffix at a sorts before the one at b (equal ones do not)."""
        n = self.extension(a, b, most)
        end = n >= most
        at = np.where(end, 0, n)
        return ~end & (self.data[a + at] < self.data[b + at])


def sort_runs(table: Prefixes, starts: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes ``starts`` inside each run (``run`` ascending), by mergesort.

    All runs are merged at once: at each level every suffix finds its rank in
    the sibling piece by binary search and moves to its place.
    """
    n = len(starts)
    order = np.arange(n)
    begin = np.searchsorted(run, run, side="left")
    end = np.searchsorted(run, run, side="right")
    size, longest = 1, int((end - begin).max(initial=0))
    where = np.arange(n)
    while size < longest:
        inside = where - begin
        piece = inside // size
        mine = begin + piece * size
        other = begin + (piece ^ 1) * size
        left = piece % 2 == 0
        lo = np.minimum(other, end)
        top = np.minimum(other + size, end)
        base = lo.copy()
        now = starts[order]
        while True:
            open_ = np.flatnonzero(lo < top)
            if not len(open_):
                break
            mid = (lo[open_] + top[open_]) // 2
            x, y = now[mid], now[open_]
            # Equal suffixes keep their order: the left piece's go first.
            before = np.where(left[open_], table.below(x, y, most), ~table.below(y, x, most))
            lo[open_] = np.where(before, mid + 1, lo[open_])
            top[open_] = np.where(before, top[open_], mid)
        target = np.minimum(mine, other) + (where - mine) + (lo - base)
        moved = np.empty(n, np.int64)
        moved[target] = order
        order = moved
        size *= 2
    return order


def repeats(slices: list[tuple[int, bytes, int, int, int, bytes]], length: int) -> list[tuple[bytes, int, int]]:
    """(doc, lo, hi) covered in single slices; slices are (key, doc, lo, offset, n, bytes), sorted by key."""
    data = np.frombuffer(b"".join(s[5] for s in slices), np.uint8)
    table = Prefixes(data)
    sizes = np.array([len(s[5]) for s in slices])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    wins = sizes - length + 1
    owner = np.repeat(np.arange(len(slices)), wins)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)
    starts = base[owner] + inside
    keys = np.unique(np.array([s[0] for s in slices]), return_inverse=True)[1]
    ahead = np.array([s[3] for s in slices])[owner] - inside  # distance to the anchor
    run = keys[owner].astype(np.int64) * (length + 1) + ahead
    by_run = np.argsort(run, kind="stable")
    starts, owner, run = starts[by_run], owner[by_run], run[by_run]
    # Runs of one suffix have nothing to meet.
    alone = np.ones(len(run), bool)
    alone[1:] &= run[1:] != run[:-1]
    alone[:-1] &= run[:-1] != run[1:]
    starts, owner, run = starts[~alone], owner[~alone], run[~alone]
    if not len(run):
        return []
    order = sort_runs(table, starts, run, length)
    starts, owner = starts[order], owner[order]
    side = np.flatnonzero(run[1:] == run[:-1])
    side = side[table.extension(starts[side], starts[side + 1], length) >= length]
    # Verified byte by byte, in pieces that stay small.
    hit = np.zeros(len(starts), bool)
    for k in range(0, len(side), 20_000):
        s = side[k : k + 20_000]
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        s = s[(view[starts[s]] == view[starts[s + 1]]).all(axis=1)]
        hit[s] = hit[s + 1] = True
    found = []
    place = np.flatnonzero(hit)
    place = place[np.lexsort((starts[place], owner[place]))]
    for i in place.tolist():
        s = slices[owner[i]]
        if s[4] > 1:
            continue
        lo = s[2] + int(starts[i] - base[owner[i]])
        if found and found[-1][0] == s[1] and found[-1][1] <= lo <= found[-1][2]:
            found[-1] = (s[1], found[-1][1], max(found[-1][2], lo + length))
        else:
            found.append((s[1], lo, lo + length))
    return found


#: ``offset`` leads from ``lo`` to the anchor; ``n`` slices are equal to this one.
SLICES = "key long, doc binary, lo long, offset long, n long, bytes binary"
PIECES = SLICES + ", sig binary"
ARROW = pa.schema(
    [("key", pa.int64()), ("doc", pa.binary()), ("lo", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
)


def _cut(length: int):
    """(doc, text, asked) to the asked slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8", "surrogatepass")
                rows = [
                    (a["key"], doc, a["lo"], a["anchor"] - a["lo"], a["n"], data[a["lo"] : a["hi"] + length]) for a in asked
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    return run


def _sort(length: int):
    """Slices in key order to (doc, lo, hi)."""

    def out(found):
        cols = list(zip(*found))
        kinds = (pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SORTED_BYTES and row[0] != held[-1][0]:
                    if found := repeats(held, length):
                        yield out(found)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held and (found := repeats(held, length)):
            yield out(found)

    return run


def _finer(length: int, size: int):
    """Slices to their pieces, a piece for each range of ``size`` offsets from the anchor."""
    from xxhash import xxh64_intdigest

    schema = ARROW.append(pa.field("sig", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 100):
                rows = []
                for _, doc, lo, offset, n, data in zip(*(c.to_pylist() for c in batch.slice(part, 100).columns)):
                    least = offset - (len(data) - length)
                    for low in range(least // size * size, offset + 1, size):
                        first, last = min(offset, low + size - 1), max(least, low)
                        # All windows with offsets low to low + size - 1 hold these bytes.
                        common = data[offset - low : offset - (low + size - 1) + length]
                        piece = data[offset - first : offset - last + length]
                        key = _signed(xxh64_intdigest(common, low))
                        rows.append((key, doc, lo + offset - first, first, n, piece, _digest(piece, first)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


SPANS = "doc binary, lo long, hi long"


def spans(keyed: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc, lo, hi): byte ranges of (doc, text) that repeats cover; they may overlap. Reads tables of ``scratch``."""
    found = keyed.mapInArrow(_scan(length), "doc binary, anchor long, lo long, hi long, key long, sig binary")
    found = scratch(found, "anchors")
    slices = scratch(
        found.groupBy("key", "sig").agg(
            F.count("*").alias("n"), F.min(F.struct("doc", "lo", "hi", "anchor")).alias("at")
        ),
        "slices",
    )
    out = [
        found.join(slices.filter("n > 1").select("key", "sig"), ["key", "sig"])
        .select("doc", "lo", (F.col("hi") + length).alias("hi"))
    ]
    mixed = slices.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    asked = (
        slices.join(mixed, "key")
        .select(F.col("at.doc").alias("doc"), F.struct("key", "at.lo", "at.hi", "at.anchor", "n", "kinds").alias("a"))
        .groupBy("doc")
        .agg(F.collect_list("a").alias("asked"))
    )
    cut = keyed.dropDuplicates(["doc"]).join(asked, "doc").select("doc", "text", "asked").mapInArrow(_cut(length), SLICES)
    cut = scratch(cut, "cut")
    names = [f.name for f in ARROW]
    size = length // 2
    while True:
        crowded = scratch(mixed.filter(F.col("kinds") > SORTED_TOGETHER).select("key"), "crowded")
        few = cut.join(crowded, "key", "left_anti").select(*names)
        out.append(few.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), SPANS))
        if size == 1 or crowded.isEmpty():
            return reduce(DataFrame.unionByName, out)
        size = (size + 1) // 2
        pieces = cut.join(crowded, "key", "left_semi").select(*names).mapInArrow(_finer(length, size), PIECES)
        pieces = scratch(pieces, "pieces")
        kinds = scratch(
            pieces.groupBy("key", "sig").agg(
                F.count("*").alias("times"), F.sum("n").alias("alike"), F.min(F.struct("doc", "lo")).alias("at")
            ),
            "kinds",
        )
        again = pieces.join(kinds.filter("times > 1").select("key", "sig"), ["key", "sig"])
        out.append(again.select("doc", "lo", (F.col("lo") + F.length("bytes")).alias("hi")))
        mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        first = kinds.join(mixed, "key").select("key", "sig", "alike", F.col("at.doc").alias("doc"), F.col("at.lo").alias("lo"))
        cut = pieces.drop("n").join(first, ["key", "sig", "doc", "lo"]).withColumnRenamed("alike", "n").select(*names)
        cut = scratch(cut, "cut")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): what is left of every text, as bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    key = document_key(id_col, text)
    key = F.unhex(F.concat(*[F.lpad(F.hex(key[half]), 16, "0") for half in "ab"]))
    base = docs.select(F.col(id_col).alias("id"), key.alias("doc"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        merged = spans(base.select("doc", "text"), length, scratch)
        merged = stored(merged.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                at, pieces, gone, count = 0, [], 0, 0
                end = -1
                for s in sorted((s["lo"], s["hi"]) for s in found or []):
                    if s[0] > end:
                        count += 1
                        pieces.append(data[at : s[0]])
                        gone += s[1] - s[0]
                        at = end = s[1]
                    elif s[1] > end:
                        gone += s[1] - end
                        at = end = s[1]
                pieces.append(data[at:])
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(count)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = base.join(merged, "doc", "left").select("id", "text", "spans")
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
