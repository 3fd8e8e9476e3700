"""Document quality by a factorisation machine.

Inputs of a document are its distinct words, hashed, with equal weights of
total length one, and bins of structure statistics (words, lines, symbols,
letter case, repeats, sentence ends) and of metadata (the stated number of
characters, against the real one). A second-order factorisation machine gives
every input a weight and a vector of ``rank`` numbers; each pair of inputs
counts by the product of their vectors. The pairs are never formed: their sum
is half of (square of the sum less sum of the squares), so a score takes time
in proportion to the inputs (Rendle, 2010).

Learning draws at most about ``sample_rows`` labelled rows by a hash of their
ids (documented bound; the share is set by the count of the labels). Their
inputs are made on all executors; the sparse inputs of that bounded sample are
learnt from in one task by AdaGrad in a fixed order, so reruns agree. Scoring
covers every document and sends the tasks a model of fixed size (``buckets``
and bins, times ``rank`` + 1 numbers of 4 bytes).

Nulls: a null text counts as empty and gets a score too; a null id is scored
and never learnt from; a null label is no label; several labels of one id count
by their mean. Without labels every score is 0.5. A null number of characters
is a bin of its own. Repeated rows get equal scores; an empty table gives an
empty result; other columns are not carried. Whole texts are read, in memory in
proportion to the longest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SENTENCE_ENDS = (b".", b"!", b"?", b'."', b".)")
#: Upper edges of the bins of a share.
SHARES = [0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]
SIZES = [0, 5, 10, 20, 35, 50, 80, 120, 200, 400, 800, 1600, 4000, 10000, 40000]
LENGTHS = [2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12, 20]
#: Each statistic and the upper edges of its bins.
STATISTICS = {
    "words": SIZES,
    "lines": [0, 1, 2, 3, 5, 8, 15, 30, 80],
    "words_a_line": [1, 3, 6, 10, 20, 40, 80, 200],
    "word_length": LENGTHS,
    "upper": SHARES,
    "lower": SHARES,
    "digits": SHARES,
    "symbols": SHARES,
    "exclamations": SHARES,
    "bars": SHARES,
    "beyond_ascii": SHARES,
    "distinct_words": SHARES,
    "repeated_lines": SHARES,
    "repeated_triples": SHARES,
    "lines_with_end": SHARES,
    "stated_size": [-1, 0, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 50000],
    "stated_difference": [-1, 0, 0.01, 0.1, 0.5],
}
N_BINS = sum(len(edges) + 1 for edges in STATISTICS.values())


def structure(text: str, body: bytes, words: list[bytes], stated: int | None) -> list[float]:
    """The statistics, in the order of STATISTICS."""
    size, n = max(len(body), 1), max(len(words), 1)
    lines = [x for x in body.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    triples = max(len(words) - 2, 1)

    def share(chars: bytes) -> float:
        return 1 - len(body.translate(None, chars)) / size if body else 0.0

    return [
        len(words),
        len(lines),
        len(words) / n_lines,
        len(body) / n,
        share(UPPER),
        share(LOWER),
        share(DIGITS),
        share(SYMBOLS) * 4,
        body.count(b"!") / n,
        body.count(b"|") / n,
        1 - len(text) / size if body else 0.0,
        len(set(words)) / n,
        1 - len(set(lines)) / n_lines,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        sum(x.rstrip().endswith(SENTENCE_ENDS) for x in lines) / n_lines,
        -1 if stated is None else stated,
        -1 if stated is None else abs(stated - len(text)) / max(len(text), 1),
    ]


def inputs(text: str | None, stated: int | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of a document: word buckets first, then a one per statistic's bin."""
    text = text or ""
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()
    places = np.unique(np.fromiter((crc32(w.lower()) % buckets for w in set(words)), np.int32))
    values = np.full(len(places), 1 / math.sqrt(max(len(places), 1)), np.float32)
    bins, first = [], buckets
    for value, edges in zip(structure(text, body, words, stated), STATISTICS.values(), strict=True):
        bins.append(first + int(np.searchsorted(edges, value)))
        first += len(edges) + 1
    return np.append(places, np.array(bins, np.int32)), np.append(values, np.ones(len(bins), np.float32))


@dataclass
class Machine:
    """A factorisation machine: one bias, a weight and a vector per input."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray

    @staticmethod
    def new(n_inputs: int, rank: int, seed: int) -> Machine:
        rng = np.random.default_rng(seed)
        return Machine(0.0, np.zeros(n_inputs, np.float32), rng.normal(0, 0.05, (n_inputs, rank)).astype(np.float32))

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        """bias + sum of weights + sum over all pairs, without the pairs."""
        scaled = self.vector[places] * values[:, None]
        total = scaled.sum(axis=0)
        pairs = 0.5 * (float(total @ total) - float((scaled * scaled).sum()))
        return self.bias + float(self.weight[places] @ values) + pairs

    def learn(self, rows: list[tuple[float, np.ndarray, np.ndarray]], passes: int, step: float, decay: float, seed: int) -> None:
        """AdaGrad on the logistic loss, row by row in a seeded order."""
        if not rows:
            return
        share = (sum(y for y, _, _ in rows) + 0.5) / (len(rows) + 1)
        self.bias = math.log(share / (1 - share))
        seen_bias, seen_w, seen_v = 1.0, np.ones_like(self.weight), np.ones_like(self.vector)
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for k in rng.permutation(len(rows)):
                y, places, values = rows[k]
                slope = _share(self.margin(places, values)) - y
                scaled = self.vector[places] * values[:, None]
                # The slope of the pairs for one vector: its value times the sum of all the others.
                for_v = slope * values[:, None] * (scaled.sum(axis=0) - scaled) + decay * self.vector[places]
                for_w = slope * values + decay * self.weight[places]
                seen_bias += slope * slope
                seen_w[places] += for_w * for_w
                seen_v[places] += for_v * for_v
                self.bias -= step * slope / math.sqrt(seen_bias)
                self.weight[places] -= step * for_w / np.sqrt(seen_w[places])
                self.vector[places] -= step * for_v / np.sqrt(seen_v[places])


def _share(margin: float) -> float:
    return 1 / (1 + math.exp(-margin)) if margin >= 0 else math.exp(margin) / (1 + math.exp(margin))


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample_of(labels: DataFrame, id_col: str, label: str, folds: int, sample_rows: int) -> DataFrame:
    """(id, y): labelled ids outside the held-out fold, about ``sample_rows`` of them at most, by hash."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
        .filter(fold_of(F.col("id"), folds) != 0)
    )
    share = min(1.0, sample_rows / max(known.count(), 1))
    return known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 15,
    rank: int = 8,
    sample_rows: int = 6_000,
    passes: int = 4,
    step: float = 0.1,
    decay: float = 1e-5,
    folds: int = 5,
    id_col: str = "doc_id",
    text: str = "text",
    size_col: str | None = "n_chars",
    label: str = "quality",
    seed: int = 11,
) -> Machine:
    """A machine learnt from labelled documents outside the held-out fold."""
    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), size.alias("stated"))
    # The sample's size is bounded by its parameter, so it goes to the documents and no text is dealt out.
    drawn = rows.join(F.broadcast(sample_of(labels, id_col, label, folds, sample_rows)), "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [inputs(t, n, buckets) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tolist() for p, _ in made], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in made], pa.list_(pa.float32()))],
                names=["order", "y", "places", "values"],
            )

    ready = drawn.select(F.xxhash64("id", "text").alias("order"), "y", "text", "stated").mapInArrow(
        make, "order long, y double, places array<int>, values array<float>"
    )

    def learn(_: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("order", kind="stable")
        machine = Machine.new(buckets + N_BINS, rank, seed)
        machine.learn(list(zip(sample["y"], sample["places"], sample["values"])), passes, step, decay, seed)
        return pd.DataFrame(
            {"bias": [machine.bias], "weight": [machine.weight.tobytes()], "vector": [machine.vector.tobytes()]}
        )

    row = ready.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "bias double, weight binary, vector binary").first()
    if row is None:
        return Machine(0.0, np.zeros(buckets + N_BINS, np.float32), np.zeros((buckets + N_BINS, rank), np.float32))
    vector = np.frombuffer(row["vector"], np.float32).reshape(-1, rank)
    return Machine(row["bias"], np.frombuffer(row["weight"], np.float32), vector)


def score(
    docs: DataFrame,
    machine: Machine,
    folds: int = 5,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text: str = "text",
    size_col: str | None = "n_chars",
) -> DataFrame:
    """(id, held_out, score, predicted) of every document; ``held_out`` is false for a null id."""
    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    held = F.coalesce(fold_of(F.col(id_col), folds) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text).cast("string").alias("text"), size.alias("stated"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Machine(*shared.value)
        buckets = len(here.weight) - N_BINS
        for batch in batches:
            texts, sizes = batch.column(2), batch.column(3).to_pylist()
            scores = [_share(here.margin(*inputs(t.as_py(), n, buckets))) for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
