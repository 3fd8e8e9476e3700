"""Line dedup by a deletion-neighbourhood join.

Two lines are near when one edit (a character put in, taken out or replaced)
turns one into the other. Each line emits the hashes of what is left when one
character is deleted, keyed also by its place. Lines that differ by a replaced
character meet under the same rest and place; a line that lacks a character
meets the rest that equals it. What meets under a key is near its earliest
member, so links are one per member and never pairs of a group. Links are
verified by edit distance. A line goes when an earlier near or equal line is
there; the earliest stays.

Only lines that can have a partner emit: one edit leaves one half of the
shorter line untouched, so a line must share a half (with that length) with a
different line. That test is exact and keeps the neighbourhoods small.

"Earlier" is by (id, place of the line in its text), null ids last; documents
that differ under one id are ordered by a hash of the text. Lines without a word are never
touched. Lines below ``min_near`` characters are only compared for equality:
one edit is more than a fifth of them and makes a different line. Nulls: a null text stays null and
has no lines. Rows that repeat (same id and text) count as one document and get
equal results. An empty table gives an empty one; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Scratch, document_key, flagged, fresh, key_map, stored

P1, P2 = 2_147_483_647, 2_147_483_629
B1, B2 = 1_000_003, 777_767_777
WORD = r"[^\x20\x09-\x0D]"
#: Fewest characters of a line that can be near another one.
MIN_NEAR = 5


def powers(base: int, mod: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo mod, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % mod
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(mod)
        have += more
        step = step * step % mod
    return out


def deletion_hashes(line: str) -> tuple[int, np.ndarray]:
    """The hash of a line, and of the line without its i-th character for every i.

    Polynomial hashes modulo two primes: deleting a character is the prefix's
    sum plus the suffix's sum moved down by one power.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    whole, parts = [], []
    for base, mod in ((B1, P1), (B2, P2)):
        m = np.uint64(mod)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, mod, n) % m, out=sums[1:])
        back = np.uint64(pow(base, -1, mod))
        rest = (sums[-1] - sums[1:]) % m * back % m
        parts.append((sums[:-1] % m + rest) % m)
        whole.append(int(sums[-1] % m))
    return whole[0] << 31 | whole[1], (parts[0] << np.uint64(31) | parts[1]).astype(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, line) to (no, key, spot): spot -1 is the line itself."""
    names = ["no", "key", "spot"]
    for batch in batches:
        held, rows = [], 0
        for i, line in enumerate(batch.column(1).to_pylist()):
            full, rest = deletion_hashes(line)
            keys = np.concatenate(([full], rest))
            spots = np.arange(-1, len(rest), dtype=np.int32)
            held.append((i, keys, spots))
            rows += len(keys)
            if rows > 200_000 or i == batch.num_rows - 1:
                which = np.concatenate([np.full(len(k), j) for j, k, _ in held])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(which)),
                        pa.array(np.concatenate([k for _, k, _ in held])),
                        pa.array(np.concatenate([s for _, _, s in held])),
                    ],
                    names=names,
                )
                held, rows = [], 0


def dropped_lines(docs: DataFrame, id_col: str, text: str, min_near: int = MIN_NEAR) -> DataFrame:
    """(doc, at, n_near): the places of the lines to remove, in order, and how many of them go for a near line.

    ``doc`` is the key of id and text. A line whose text goes for an earlier
    near line counts as near; else an equal line came earlier.
    """
    lines = docs.select(
        F.col(id_col).alias("id"),
        document_key(id_col, text).alias("doc"),
        F.posexplode(F.split(text, "\n")).alias("at", "line"),
    ).filter(F.col("line").rlike(WORD))
    # Two hashes name a line; its place orders it among all lines.
    named = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("2"), F.col("line"))})
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("doc").alias("doc"), F.col("at").alias("at"))
    n = F.length("line")
    # The halves that one edit leaves whole, if the shorter line has n or n - 1 characters.
    halves = F.when(
        n >= min_near,
        F.array(
            *[
                F.xxhash64(F.lit(side), m, cut(F.col("line"), F.floor(m / 2).cast("int")))
                for side, cut in ((0, F.left), (1, F.right))
                for m in (n, n - 1)
            ]
        ),
    )

    def spot(doc, at):
        return F.xxhash64(doc["a"], doc["b"], at)

    with Scratch(docs.sparkSession) as keep:
        first = keep(
            named.withColumns({"place": place, "halves": halves})
            .groupBy("h1", "h2")
            .agg(F.min("place").alias("place"), F.count("*").alias("n"), F.first("halves").alias("halves")),
            "lines",
        )
        half = first.filter("halves IS NOT NULL").select("h1", "h2", F.explode(F.array_distinct("halves")).alias("half"))
        shared = half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
        able = half.join(shared, "half").select("h1", "h2").distinct()
        able = keep(able.join(first.select("h1", "h2", "place"), ["h1", "h2"]), "able")
        # The text of a line is fetched at its first place only; all other lines stay where they are.
        bits = key_map(able, spot(F.col("place.doc"), F.col("place.at")))
        at_first = flagged(named, spot(F.col("doc"), F.col("at")), bits, "may").filter("may").drop("may")
        candidates = (
            at_first.join(able, ["h1", "h2"])
            .filter((F.col("doc") == F.col("place.doc")) & (F.col("at") == F.col("place.at")))
            .dropDuplicates(["h1", "h2"])
        )
        # Numbers that rise with the place stand for the lines from here on.
        numbered = keep(
            candidates.select("place", "line")
            .repartitionByRange("place")
            .sortWithinPartitions("place")
            .select(F.monotonically_increasing_id().alias("no"), "place", "line"),
            "near",
        )
        keep.drop(able)
        emitted = keep(numbered.select("no", "line").mapInArrow(_emit, "no long, key long, spot int"), "deletions")
        ends = emitted.groupBy("key").agg(
            F.count("*").alias("n"),
            F.min(F.when(F.col("spot") < 0, F.col("no"))).alias("whole"),
            F.min(F.when(F.col("spot") >= 0, F.col("no"))).alias("longer"),
        )
        met = keep(emitted.join(ends.filter("n > 1"), "key").select("no", "key", "spot", "whole", "longer"), "met")
        keep.drop(emitted)
        # Replaced character: all members of (key, spot) are near the earliest of them.
        swaps = met.filter("spot >= 0").groupBy("key", "spot").agg(F.min("no").alias("to"), F.count("*").alias("n"))
        by_swap = met.join(swaps.filter("n > 1").drop("n"), ["key", "spot"]).filter("no > to").select("no", "to")
        # Missing character: the line itself against all that become it by a deletion.
        to_whole = met.filter("spot >= 0 AND no > whole").select("no", F.col("whole").alias("to"))
        to_longer = met.filter("spot < 0 AND no > longer").select("no", F.col("longer").alias("to"))
        links = by_swap.unionByName(to_whole).unionByName(to_longer).distinct()
        gone = (
            links.join(numbered.select("no", "place", F.col("line").alias("a")), "no")
            .join(numbered.select(F.col("no").alias("to"), F.col("line").alias("b")), "to")
            .filter(F.levenshtein("a", "b", 1).between(0, 1))
            .select("place")
            .distinct()
            .withColumn("near", F.lit(True))
        )
        marked = first.join(gone, "place", "left").filter((F.col("n") > 1) | F.col("near"))
        marked = keep(marked.select("h1", "h2", "place", F.coalesce("near", F.lit(False)).alias("near")), "marked")
        # Lines that are there once and near none take no part in the last join.
        some = flagged(named.select("doc", "at", "h1", "h2"), F.col("h1"), key_map(marked, F.col("h1")), "may").filter("may")
        removed = (
            some.join(marked, ["h1", "h2"])
            .filter(F.col("near") | (F.col("doc") != F.col("place.doc")) | (F.col("at") != F.col("place.at")))
            .select("doc", "at", "near")
        )
        # Repeats of a document give the same (doc, at) more than once.
        return stored(
            removed.groupBy("doc").agg(
                F.array_sort(F.collect_set("at")).alias("at"), F.size(F.collect_set(F.when(F.col("near"), F.col("at")))).alias("n_near")
            ),
            "removed",
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """The input with the kept lines as its text, and ``n_lines``, ``n_removed``,
    ``n_near`` (long): its lines with a word, those removed, those of them that
    went for a near line. Columns of these names are replaced."""
    made = ["n_lines", "n_removed", "n_near"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (id_col, text)])
    doc, at, gone, may = (fresh(base, name) for name in ("_doc", "_at", "_gone", "_may"))
    removed = dropped_lines(docs, id_col, text, min_near).withColumnsRenamed({"doc": doc, "at": at, "n_near": gone})
    told = flagged(base.withColumn(doc, document_key(id_col, text)), F.col(doc)["a"], key_map(removed, F.col(doc)["a"]), may)
    # Documents that lose no line are not dealt out for the join.
    nothing = {at: F.lit(None).cast("array<int>"), gone: F.lit(None).cast("int")}
    joined = told.filter(may).join(removed, doc, "left").unionByName(told.filter(~F.col(may)).withColumns(nothing))
    parts = F.split(text, "\n")
    # A map looks up by scanning, so the flags are an array by place.
    kept = F.when(F.col(at).isNull(), F.col(text)).otherwise(_without(parts, F.col(at)))
    count = F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.rlike(WORD)))
    out = joined.withColumns(
        {
            "n_lines": count.cast("long"),
            "n_removed": F.coalesce(F.size(at), F.lit(0)).cast("long"),
            "n_near": F.coalesce(F.col(gone), F.lit(0)).cast("long"),
        }
    )
    return out.withColumn(text, kept).select(*base.columns, *made)


def _without(parts, flags):
    """The lines whose place is not among the sorted ``flags``: both lists are walked
    by joining the stretches between two removed places."""
    bounds = F.concat(F.array(F.lit(-1)), flags, F.array(F.size(parts)))
    stretches = F.transform(
        F.slice(bounds, F.lit(1), F.size(bounds) - 1),
        lambda b, i: F.slice(parts, b + 2, F.get(bounds, i + 1) - b - 1),
    )
    return F.array_join(F.flatten(stretches), "\n")


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The documents with their repeated lines removed, in the columns of the input.

    No document goes: one that was only repeats is left with what has no words.
    A column ``n_chars`` is set to the new length.
    """
    out = dedup_lines(docs, **settings)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(settings.get("text", "text")).cast("long"))
    return out.select(*docs.columns)
