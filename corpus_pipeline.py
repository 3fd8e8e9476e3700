"""A training-corpus pipeline: each stage works on all that the one before kept.

``run`` writes every stage as Parquet in the shared checkpoint folder and reads
it again for the next, so a lost executor replays one stage at most. Each stage
takes (spark, docs, sf_dir) and treats nulls, repeats and empty tables as its
operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aisleframe.llm import decontam, line_dedup, mixing, quality, simhash
from aisleframe.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near or equal to an earlier line go; every document stays."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return simhash.one_of_each_group(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
]

#: The near-duplicate and mixing stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus made from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
