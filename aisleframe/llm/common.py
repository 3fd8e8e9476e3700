"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.session import delete_folder, ensure_checkpoint_dir, settle, shared_folder, stored

__all__ = ["Scratch", "document_key", "flagged", "fresh", "key_map", "settle", "shared_folder", "stored", "table", "without", "words_of"]

#: Bits of the maps that tell rows a key surely has not from those it may have: 2^18 rows of 64 at most.
MAP_BITS = 24
#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


class Scratch:
    """Tables that last no longer than the ``with`` block they are made in.

    What an operator returns must not read them: it stores its own small result
    first. ``drop`` takes a table away ahead of the end of the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        ensure_checkpoint_dir(self.spark)
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(self.spark, name)
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = out, folder
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.folders:
                delete_folder(self.spark, self.folders.pop(id(table))[1])

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in list(self.folders.values())])


def document_key(id_col: str | Column, text: str | Column) -> Column:
    """128 bits that stand for a document's id and text."""
    id_col, text = (F.col(c) if isinstance(c, str) else c for c in (id_col, text))
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit("second"), text, id_col).alias("b"))


def key_map(keys: DataFrame, key: Column) -> DataFrame:
    """A bit map of 64-bit keys, as at most 2 ** (MAP_BITS - 6) rows however many keys there are."""
    slot = F.shiftrightunsigned(key, 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    return keys.select(F.shiftright(slot, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def flagged(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false where the map surely lacks the key. The map's size is fixed, so it is broadcast."""
    slot = F.shiftrightunsigned(key, 64 - MAP_BITS)
    word, held = fresh(rows, "_word"), fresh(rows, "_bits")
    small = F.broadcast(bits.select(F.col("_word").alias(word), F.col("_bits").alias(held)))
    joined = rows.withColumn(name, slot).join(small, F.shiftright(F.col(name), 6) == F.col(word), "left")
    hit = F.call_function("shiftright", F.col(held), F.col(name).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, held)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a document key) is not in ``gone``, a written table of that one column.

    Rows that the bit map clears stay where they are; only the others, with
    their texts, are dealt out for the join.
    """
    may = fresh(rows, "_may")
    told = flagged(rows, F.col(key)["a"], key_map(gone, F.col(key)["a"]), may)
    rest = told.filter(may).join(gone, key, "left_anti")
    return told.filter(~F.col(may)).unionByName(rest).drop(may)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
