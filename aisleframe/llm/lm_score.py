"""Cross-entropy difference of documents between a target and a background model.

Both are character n-gram models of the same order over one shared vocabulary:
every character of the corpus, whatever its script, and one symbol for
characters never seen. Both are smoothed alike, and the background's counts are
scaled to the target's total, so that only their proportions differ. A
document's score is its mean loss per token under the target model minus that
under the background model, in bits; below zero it looks more like the target.

Neither vocabulary nor n-grams have a fixed number, so no model is collected or
broadcast. Documents are packed into chunks of bounded length, each with its
distinct n-grams. Those are summed over all chunks to a stored table, the
table's losses go back to the chunks by a shuffled join, and each chunk scores
its documents. A frequent n-gram has one row a chunk, so no key is hot.

Nulls: a null text is empty; an empty text has no token, null losses and a null
score. A null id is carried and is never a target. Repeated rows count as often
as they are there. With no target document every n-gram falls back on the
uniform model; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import stored

#: Characters after which a chunk of documents is closed.
CHUNK = 1_000_000


def distinct_grams(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of lower-case texts, and the place in that list of every token's n-gram.

    A text's first tokens have n-grams shorter than ``order``: their start is padding.
    """
    flat = "".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    known, ids = np.unique(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    at, size, span = np.arange(len(flat)), len(known) + 1, 1
    cell = np.zeros(len(flat), np.int64)
    for back in range(order - 1, -1, -1):
        if span > 2**62 // size:
            seen, cell = np.unique(cell, return_inverse=True)
            span = len(seen)
        cell = cell * size + np.where(at - back >= begin, ids[np.maximum(at - back, 0)] + 1, 0)
        span *= size
    _, first, place = np.unique(cell, return_index=True, return_inverse=True)
    return [flat[max(a - order + 1, b) : a + 1] for a, b in zip(first.tolist(), begin[first].tolist())], place


def chunked(marked: DataFrame, kind: str, order: int) -> DataFrame:
    """Chunks of (id, text, is_target): a row (chunk, place, gram, target, background) for every distinct
    n-gram with its counts, and one row (chunk, ids, lengths, tokens) with the places of all tokens, packed."""
    schema = f"chunk long, place long, gram string, target long, background long, ids array<{kind}>, lengths array<long>, tokens binary"
    id_type = marked.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = to_arrow_type(id_type)
        names = ["chunk", "place", "gram", "target", "background", "ids", "lengths", "tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(own), pa.list_(pa.int64()), pa.binary()]
        number = TaskContext.get().partitionId() << 32
        ids, texts, flags, length = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            grams, place = distinct_grams(texts, order)
            lengths = [len(t) for t in texts]
            target = np.bincount(place[np.repeat(np.array(flags, bool), lengths)], minlength=len(grams))
            columns = [[number] * len(grams), range(len(grams)), grams, target, np.bincount(place, minlength=len(grams))]
            for a in range(0, len(grams), 50_000):
                rows = [pa.array(c[a : a + 50_000], t) for c, t in zip(columns, types)]
                rows += [pa.nulls(len(rows[0]), t) for t in types[5:]]
                yield pa.RecordBatch.from_arrays(rows, names=names)
            tokens = zlib.compress(place.astype("<u2" if len(grams) <= 2**16 else "<u4").tobytes(), 1)
            row = [[number], [len(grams)], [None], [None], [None], [ids], [lengths], [tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=names)

        for batch in batches:
            for i, t, flag in zip(*(c.to_pylist() for c in batch.columns)):
                t = (t or "").lower()
                if texts and length + len(t) > CHUNK:
                    yield from close()
                    ids, texts, flags, length, number = [], [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                flags.append(flag)
                length += len(t)
        if texts:
            yield from close()

    return marked.mapInArrow(run, schema)


def gram_losses(totals: DataFrame, order: int, prior: float) -> DataFrame:
    """(gram, own, other): bits per token under both models for every n-gram of (gram, target, background)."""
    top = totals.agg(
        F.sum("target").alias("target"), F.sum("background").alias("background"), F.count_distinct(F.right("gram", F.lit(1))).alias("n")
    ).first()
    all_own, all_other = float(top["target"] or 0), float(top["background"] or 0)
    scale = max(all_own, 1.0) / all_other if all_other else 1.0
    level = totals.select("gram", F.col("target").cast("double").alias("own"), (F.col("background") * scale).alias("other"))
    levels = [level]
    for k in range(order - 1, 0, -1):
        level = level.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
        levels.append(level)
    uniform = 1.0 / (top["n"] + 1)
    p = levels[-1].select(
        "gram",
        ((F.col("own") + prior * uniform) / (all_own + prior)).alias("own"),
        ((F.col("other") + prior * uniform) / (all_other * scale + prior)).alias("other"),
    )
    for k, level in enumerate(reversed(levels[:-1]), 2):
        level = level.withColumn("before", F.expr("substring(gram, 1, length(gram) - 1)"))
        level = level.withColumn("after", F.right("gram", F.lit(k - 1)))
        sums = level.groupBy("before").agg(F.sum("own").alias("own_all"), F.sum("other").alias("other_all"))
        lower = p.select(F.col("gram").alias("after"), F.col("own").alias("own_p"), F.col("other").alias("other_p"))
        p = level.join(sums.hint("merge"), "before").join(lower.hint("merge"), "after").select(
            "gram",
            *[((F.col(c) + prior * F.col(f"{c}_p")) / (F.col(f"{c}_all") + prior)).alias(c) for c in ("own", "other")],
        )
    return p.select("gram", *[(-F.log2(c)).alias(c) for c in ("own", "other")])


def losses(counts: np.ndarray, size: int, order: int, prior: float) -> np.ndarray:
    """Bits per token of every cell of a dense table; each order is a prior of weight ``prior`` for the next.

    The same formula as ``gram_losses``, for a vocabulary small enough for an array.
    """
    p = np.full((1,) * (order - 1) + (size,), 1.0 / size)
    table = counts.reshape((size,) * order)
    for k in range(1, order + 1):
        c = table.sum(axis=tuple(range(order - k)), keepdims=True) if k < order else table
        p = (c + prior * p) / (c.sum(axis=-1, keepdims=True) + prior)
    return -np.log2(p).reshape(-1)


def cross_entropy_difference(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    order: int = 3,
    prior: float = 5.0,
) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score); ``targets`` has the ids of the target documents."""
    # The target list has no proven bound, so it is dealt out by id at every size instead of broadcast.
    wanted = targets.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    marked = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(
        wanted.withColumn("is_target", F.lit(True)).hint("shuffle_hash"), "id", "left"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    marked = marked.select("id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    # Stored, so that both models and the scores see the same chunks.
    chunks = stored(chunked(marked, kind, order), "chunks")
    asked = chunks.filter("gram IS NOT NULL")
    totals = asked.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    table = gram_losses(stored(totals, "grams"), order, prior)
    bits = asked.select("chunk", "place", "gram").join(table.hint("merge"), "gram").select("chunk", "place", "own", "other")
    packed = chunks.filter("gram IS NULL").select(F.col("chunk").alias("own_chunk"), F.col("place").alias("n"), "ids", "lengths", "tokens")

    def score(bits: pa.Table, packed: pa.Table) -> pa.Table:
        at = bits.column("place").to_numpy()
        loss = np.zeros((2, len(at)))
        for k, c in enumerate(("own", "other")):
            loss[k, at] = bits.column(c).to_numpy()
        lengths = packed.column("lengths").combine_chunks().flatten()
        n = lengths.to_numpy()
        wide = "<u2" if packed.column("n")[0].as_py() <= 2**16 else "<u4"
        token = np.frombuffer(zlib.decompress(packed.column("tokens")[0].as_py()), wide)
        some = n > 0
        begin = (np.cumsum(n) - n)[some]
        mean = np.zeros((2, len(n)))
        for k in range(2):
            mean[k, some] = np.add.reduceat(loss[k][token], begin) / n[some] if some.any() else 0.0
        own, other, apart = (pa.array(c, pa.float64(), mask=~some) for c in (mean[0], mean[1], mean[0] - mean[1]))
        return pa.table(
            [packed.column("ids").combine_chunks().flatten(), lengths, own, other, apart],
            names=[id_col, "n_tokens", "target_loss", "background_loss", "score"],
        )

    return (
        bits.groupBy("chunk")
        .cogroup(packed.groupBy("own_chunk"))
        .applyInArrow(score, f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
    )
