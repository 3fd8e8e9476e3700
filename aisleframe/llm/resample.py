"""Importance resampling of documents towards a target collection.

An untrained pre-tokeniser of the ``tokenizers`` library splits the text, with
A to Z lower-cased, at its regular expression and returns words with offsets.
A feature is the window from one offset pair to a later one: one word, or up to
``max_words`` consecutive ones joined by a space. Its CRC-32 chooses a bucket.
Bucket counts of the target against those of all documents give each bucket a
gain; a document's weight is the mean gain of its features, and a Gumbel number
from its id turns the weights into a draw without replacement of a fixed share.

Documents are split once: their buckets, two bytes a feature, are written to
the shared folder, and counts and weights are read from there. Counts and gains
have one row a bucket (``buckets`` at most 65,536), so only tables of that
fixed size are sent to the tasks. Ranks come from a range partitioning by score
and the row counts of its partitions, not from one sorted task.

Nulls: a null text has no words. A text without words has no features and
weight 0; a text of one word has one. A null id draws its number as the empty
id and ranks behind equal scores. Rows that repeat each take a rank of their
own. An empty table gives an empty result; an empty target gives gains against
nothing. Very long texts take memory in proportion to their length in one task.
Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.llm.common import settle, stored

#: What lies between words: ASCII that is neither a digit nor a lower-case letter (a fixed value).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(BETWEEN_WORDS), behavior="removed")


def split_words(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The lower-cased text and the (start, end) of each word in it."""
    low = text.encode("utf-8").lower().decode("utf-8")  # bytes know ASCII letters only
    return low, [offsets for _, offsets in _splitter().pre_tokenize_str(low)]


def feature_buckets(text: str, max_words: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature): windows of 1 to ``max_words`` offset pairs."""
    low, offsets = split_words(text)
    words = [low[a:b].encode("utf-8") for a, b in offsets]
    sums = list(map(crc32, words))
    found = list(sums)
    spaced = [b" " + w for w in words]
    for k in range(1, max_words):
        # The checksum of a window goes on from that of the window one word shorter.
        sums = [crc32(w, c) for w, c in zip(spaced[k:], sums)]
        found += sums
    return len(words), (np.array(found, np.uint32) % np.uint32(buckets)).astype("<u2")


def split_documents(docs: DataFrame, max_words: int, buckets: int, id_col: str, text: str) -> DataFrame:
    """(id, n_words, buckets of all features as little-endian 16-bit numbers)."""
    key = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = key.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [feature_buckets(t.as_py() or "", max_words, buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([b.tobytes() for _, b in made], pa.binary())],
                names=["id", "n_words", "found"],
            )

    return key.mapInArrow(run, f"id {kind}, n_words long, found binary")


def bucket_counts(split: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): each task adds up its documents first and returns a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), "<u2"), minlength=buckets)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return split.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) of every bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for row in counts.collect():  # one row a bucket at most
            into[row["bucket"]] = row["n"]
    total_s, total_t = float(s.sum()), float(t.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1) * (total_s + buckets) / ((a + 1) * (total_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())],
        np.int64,
    )


def gumbel_number(id_col: Column, seed: int) -> Column:
    """A floored Gumbel number in thousandths, from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds ``place``, 1, 2, 3, ..., in the order of ``keys``."""
    # Written, as a partition made anew after a lost executor may be cut elsewhere.
    dealt = settle(rows.repartitionByRange(*keys).select("*", F.spark_partition_id().alias("_part")))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # a row a partition
    before, starts = 0, []
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    first = F.element_at(F.lit(starts or [0]), F.col("_part") + 1)
    return dealt.withColumn("place", (inside + first).cast("long")).drop("_part")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    max_words: int = 2,
    buckets: int = 10_000,
    min_words: int = 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document.

    Of the N documents with at least ``min_words`` words, the floor(percent * N
    / 100) with the highest scores are drawn, ties to the smaller id; the others
    have no rank.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    split = stored(split_documents(docs, max_words, buckets, id_col, text), "resample")
    aim = split_documents(target.withColumn("_aim", F.lit(0)), max_words, buckets, "_aim", target_text)
    gains = bucket_gains(bucket_counts(split, buckets), bucket_counts(aim, buckets), buckets)
    kind = split.schema["id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_py(), "<u2") for v in batch.column(2)]
            weight = [int(gains[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(f) for f in found], pa.int64()), pa.array(weight, pa.int64())],
                names=["id", "n_words", "n_features", "weight"],
            )

    scored = split.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long").withColumn(
        "score", F.col("weight") + gumbel_number(F.col("id"), seed)
    )
    scored = stored(scored, "resample")
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words")]
    placed = ranked(scored.filter(able), order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    out = placed.unionByName(rest, allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
