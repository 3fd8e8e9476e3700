"""Periodic runs of words, found by Descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends and that is at least ``min_words`` and
``min_repeats * q`` words long. If it begins at ``s`` and is ``L`` words long,
the suffixes at ``s`` and ``s + q`` share exactly ``L - q`` words. Suffixes that
are neighbours in suffix order are united by decreasing shared length; a class
is an ordered set of positions, and the smaller one is put into the larger.
When two positions of different classes become neighbours in their new class
at a distance the shared length allows, they seed a run, and the seed stands if
no word to the left prolongs it. By the periodicity lemma this gives each run
once, with its smallest period.

No run shares fewer than ``least`` words with itself one period on, so only
words inside windows of that many words that occur twice in the text are
sorted at all; equal hashes of windows merely add words, never lose any.

Nulls: a null text has no words and no run. An empty text is the same. A null
id is carried through; repeated rows get equal results; an empty table gives an
empty one; other columns are not carried. A text is handled in one task, in
memory in proportion to its length (the sort keeps 4 bytes a repeated word and
level, of which there are as many as doublings of the longest repeat); a word
repeated a million times takes time in proportion to n log n.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions a block of an ordered set holds before it is cut in two.
BLOCK = 1_024

RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def least_shared(min_words: int, min_repeats: int) -> int:
    """The fewest words that a run can share with itself one period on."""
    return min(max(min_words - q, (min_repeats - 1) * q) for q in range(1, max(2, min_words + 1)))


class Positions:
    """An ordered set of positions in blocks, so that one more costs little in a large set."""

    __slots__ = ("blocks", "firsts", "n")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.n = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> None:
        k = max(bisect_right(self.firsts, position) - 1, 0)
        block = self.blocks[k]
        insort(block, position)
        self.firsts[k] = block[0]
        self.n += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.firsts[k : k + 1] = [block[0], block[half]]

    def around(self, position: int) -> tuple[int, int]:
        """The neighbours of a member; -1 where there is none."""
        k = bisect_right(self.firsts, position) - 1
        block = self.blocks[k]
        at = bisect_left(block, position)
        before = block[at - 1] if at else (self.blocks[k - 1][-1] if k else -1)
        if at + 1 < len(block):
            return before, block[at + 1]
        return before, (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1)


def _repeated(codes: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words whose hash occurs twice."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n <= width:
        return covered
    # Windows grow by halves: the hash of 2k words comes from those of k words at both ends.
    total, have = None, 0
    power, part, size = np.array([0x9E3779B97F4A7C15], np.uint64), codes, 1
    while size <= width:
        if width & size:
            if total is None:
                total, have = part, size
            else:
                # total covers ``have`` words, part the ``size`` words behind them.
                m = n - have - size + 1
                total = total[:m] * power + part[have : have + m]
                have += size
        m = len(part) - size
        if m > 0:
            part = part[:m] * power + part[size : size + m]
        power = power * power
        size *= 2
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    twice = np.union1d(order[1:][same], order[:-1][same])
    if len(twice) == 0:
        return covered
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words each shares with the next, by prefix doubling."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
    order = np.argsort(rank, kind="stable")
    levels, size = [rank], 1
    while rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: max(n - size, 0)] = rank[size:].astype(np.int64) + 1
        key = rank.astype(np.int64) * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int32)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(step, dtype=np.int32)
        levels.append(rank)
        size *= 2
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = np.append(levels[k], np.int32(-1))
        shared += np.where(level[a + shared] == level[b + shared], 1 << k, 0)
    return order, shared


def find_runs(words: list, min_words: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    least = least_shared(min_words, min_repeats)
    if len(words) < max(min_words, least + 1):
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    inside = np.nonzero(_repeated(codes, least))[0]
    if len(inside) == 0:
        return []
    # Stretches of repeated words, each behind a word that occurs nowhere else.
    known: dict = {}
    ids = [known.setdefault(words[i], len(known)) for i in inside.tolist()]
    cuts = np.nonzero(np.diff(inside, prepend=-2) > 1)[0]
    x = np.insert(np.asarray(ids, np.int64), cuts, len(known) + np.arange(len(cuts)))
    place = np.insert(inside, cuts, -1).tolist()
    order, shared = suffix_order(x)
    return sorted((place[i], length, q) for i, length, q in _kruskal(x.tolist(), order, shared, least, min_words, min_repeats))


def _kruskal(x, order, shared, least: int, min_words: int, min_repeats: int) -> list[tuple[int, int, int]]:
    edges = np.nonzero(shared >= least)[0]
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    at, most = order.tolist(), min_repeats - 1
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    found = []

    def root(r: int) -> int:
        top = r
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(r, r)) != top:
            parent[r], r = top, up
        return top

    def seed(i: int, j: int, common: int) -> None:
        q = j - i
        if q * most <= common and q + common >= min_words and (i == 0 or x[i - 1] != x[j - 1]):
            found.append((i, q + common, q))

    for r, common in zip(edges.tolist(), shared[edges].tolist()):
        small, large = root(r), root(r + 1)
        lesser = members.pop(small, None) or Positions(at[small])
        larger = members.pop(large, None) or Positions(at[large])
        if lesser.n > larger.n:
            small, large, lesser, larger = large, small, larger, lesser
        parent[small] = large
        members[large] = larger
        new = list(lesser)
        for p in new:
            larger.add(p)
        own = set(new)
        for p in new:
            before, after = larger.around(p)
            if before >= 0 and before not in own:
                seed(before, p, common)
            if after >= 0 and after not in own:
                seed(p, after, common)
    return found


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge[:-1]).tolist()) if n == 0]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties to the first start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(
    docs: DataFrame,
    min_words: int = 24,
    min_repeats: int = 3,
    id_col: str = "doc_id",
    text: str = "text",
    details: bool = False,
) -> DataFrame:
    """(id, counts and digests of the runs); with ``details`` also ``runs`` and ``collapsed_text``.

    ``start``, ``length``, ``period`` and ``exponent_milli`` describe the run
    with the greatest exponent. ``runs`` lists all runs by start, then period.
    """
    key = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = key.schema["id"].dataType.simpleString()
    extra = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string" if details else ""
    each_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                # Bytes split at the six ASCII white space characters and at no other.
                words = (value or "").encode("utf-8", "surrogatepass").split()
                runs = find_runs(words, min_words, min_repeats)
                s, n, q = longest(runs) or (None, None, None)
                kept = b" ".join(collapsed(words, runs) if runs else words)
                listing = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                row = [len(runs), s, n, q, None if q is None else 1000 * n // q]
                row += [hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if details:
                    row += [[{"start": a, "length": b, "period": c} for a, b, c in runs], kept.decode("utf-8", "surrogatepass")]
                rows.append(row)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.list_(each_run), pa.string()] if details else [])
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[str(k) for k in range(len(types) + 1)])

    return key.mapInArrow(run, f"id {kind}, {RESULT}{extra}").withColumnRenamed("id", id_col)
