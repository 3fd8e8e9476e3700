"""Benchmark decontamination by spaced seeds.

A fixed mask over consecutive words ignores some of its places. The words at
the other places are hashed, for every position of every benchmark item and of
every document, and equal hashes are hits. The three masks together meet every
stretch of 13 words or more that begins and ends equal and has at most a fifth
of its words replaced (``tests`` prove it), so each overlap at 80 % identity
has a hit. Around a hit the document and the item are laid side by side, and
the longest stretch with at least ``identity`` equal words decides.

Words are runs of non-white-space in lower case, without marks at their ends.
Items under 13 words overlap as a whole only. With up to k words replaced, their
inner words are dealt over k + 1 shapes, one of which stays whole.

Before the join, hashes that no item has are dropped by a bit map of fixed size
(2^24 bits), so only hits and chance hits are shuffled; a larger benchmark
fills the map and more goes through the join, with the same result.

Nulls: a null text has no words and is never a hit; a null item is left out. A
null document id is carried; rows that repeat give repeated results of one
document. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import document_key, flagged, fresh, key_map, settle, stored, without

MASKS = ("11101011", "1011000111", "110010001001")
#: Items of fewer words than this have shapes of their own.
SHORTEST = 13
MAP_BITS = 24
EDGE_MARKS = ".,;:!?\"'()[]{}…“”‘’«»"
PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word."""
    from xxhash import xxh64_intdigest

    words = [w.strip(EDGE_MARKS) or w for w in (text or "").lower().split()]
    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _blend(columns: list[np.ndarray], salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), (salt * PRIMES[2] + 1) & (2**64 - 1), np.uint64)
        for c in columns:
            out = (out ^ c) * np.uint64(PRIMES[0])
            out ^= out >> np.uint64(31)
        out = out * np.uint64(PRIMES[1])
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def short_shapes(n: int) -> list[list[int]]:
    """Places of a whole item of ``n`` words: with both ends equal and a fifth replaced, one shape has no replaced word."""
    ways = n // 5 + 1
    return [[i for i in range(n) if i in (0, n - 1) or i % ways == k] for k in range(ways)]


def seeds(words: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all masks, and of the shapes of the ``short`` lengths."""
    hashes, places = [], []
    shapes = [(k, [i for i, c in enumerate(m) if c == "1"], len(m)) for k, m in enumerate(MASKS)]
    shapes += [(100 + 100 * s + k, on, s) for s in short for k, on in enumerate(short_shapes(s))]
    for salt, on, span in shapes:
        n = len(words) - span + 1
        if n > 0:
            hashes.append(_blend([words[i : i + n] for i in on], salt))
            places.append(np.arange(n, dtype=np.int32))
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(places)


def _scan(short: list[int], wanted: np.ndarray | None, whole_only: bool):
    """mapInArrow body: (key, text) to (key, hash, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = word_hashes(text.as_py())
                mine = [len(words)] if whole_only and 0 < len(words) < SHORTEST else [] if whole_only else short
                h, at = seeds(words, mine)
                if wanted is not None and len(h):
                    slot = (h.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    hit = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    h, at = h[hit], at[hit]
                for a in range(0, len(h), 500_000):
                    part = h[a : a + 500_000]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(len(part), i))), pa.array(part), pa.array(at[a : a + 500_000])],
                        names=["key", "hash", "place"],
                    )

    return run


def best_stretch(same: np.ndarray, identity: float) -> int:
    """Words in the longest stretch that begins and ends equal and has the wanted share of equal words."""
    # Prefix sums of (equal - identity): a stretch is good when its sum is not below 0.
    score = np.concatenate(([0.0], np.cumsum(same - identity)))
    lowest = np.minimum.accumulate(score)
    best = 0
    on = np.flatnonzero(same)
    for e in on[::-1]:
        if e + 1 <= best:
            break
        b = int(np.searchsorted(-lowest, -(score[e + 1] + 1e-9)))
        starts = on[(on >= b) & (on <= e)]
        for s in starts:
            if e + 1 - s <= best:
                break
            if score[s] <= score[e + 1] + 1e-9:
                best = int(e + 1 - s)
                break
    return best


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    identity: float = 0.8,
) -> DataFrame:
    """(id, item, overlap_words): the longest overlap of each document with each item it overlaps.

    An overlap has ``min_words`` words, or as many as a shorter item has.
    """
    items = settle(
        benchmark.filter(F.col(item_text).isNotNull())
        .select(F.col(item_col).alias("item"), F.col(item_text).alias("item_text"))
        .distinct()
        .withColumn("key", F.xxhash64("item", "item_text"))
    )
    item_seeds = settle(
        items.select("key", "item_text").mapInArrow(_scan([], None, True), "key long, hash long, place int").distinct()
    )
    lengths = items.select(F.size(F.filter(F.split(F.lower("item_text"), r"\s+"), lambda w: w != "")).alias("n")).filter(
        F.col("n").between(1, SHORTEST - 1)
    )
    short = sorted(r["n"] for r in lengths.distinct().collect())
    # The bit map: at most 2^(MAP_BITS - 6) words of 64 bits, however many items there are.
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bits = item_seeds.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63))").alias("bit"))
    wanted = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        wanted[r["word"]] = r["bits"] & (2**64 - 1)
    wanted = wanted.astype("<u8").view(np.uint8)

    keyed = docs.select(document_key(id_col, text).alias("key"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    hits = keyed.select("key", "text").mapInArrow(_scan(short, wanted, False), "key struct<a:bigint,b:bigint>, hash long, place int")
    starts = settle(
        hits.join(item_seeds.select(F.col("key").alias("item_key"), "hash", F.col("place").alias("item_place")), "hash")
        .select("key", "item_key", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    # The shifts of one item come as a list beside its text, which is there once.
    shifts = starts.groupBy("key", "item_key").agg(F.sort_array(F.collect_set("shift")).alias("shifts"))
    asked = shifts.join(items.select(F.col("key").alias("item_key"), "item", "item_text"), "item_key")
    per_doc = asked.groupBy("key").agg(F.collect_list(F.struct("item", "item_text", "shifts")).alias("asked"))
    # Only documents with a hit, and a few that share a bit with one, are dealt out with their texts.
    suspects = flagged(keyed, F.col("key")["a"], key_map(starts, F.col("key")["a"]), "_may").filter("_may")
    found = suspects.drop("_may").join(per_doc, "key").dropDuplicates(["key"]).select("id", "text", "asked")
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, body, asked in zip(frame["id"], frame["text"], frame["asked"]):
                words, known, best = word_hashes(body), {}, {}
                for a in asked:
                    t = a["item_text"]
                    if t not in known:
                        known[t] = word_hashes(t)
                    item = known[t]
                    for shift in a["shifts"]:
                        lo, hi = max(0, -shift), min(len(item), len(words) - shift)
                        same = (item[lo:hi] == words[lo + shift : hi + shift]).astype(np.float64)
                        n = best_stretch(same, identity)
                        if n and n >= min(min_words, len(item)):
                            best[a["item"]] = max(n, best.get(a["item"], 0))
                rows += [(doc_id, i, n) for i, n in best.items()]
            yield pd.DataFrame(rows, columns=["id", "item", "overlap_words"])

    out = found.mapInPandas(verify, f"id {id_kind}, item {item_kind}, overlap_words long")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "overlap_words")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that overlap no item, in the columns of the input."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, document_key(id_col, text))
    # One frame per distinct document: its key is its id here, so null ids need no special case.
    plain = keyed.select(F.col(key).alias("doc_key"), F.col(text).alias("body"))
    bad = overlaps(plain, benchmark, "doc_key", "body", **settings).select(F.col("doc_key").alias(key)).distinct()
    return without(keyed, key, stored(bad, "contaminated")).select(*docs.columns)
