"""Ingestion of a growing folder: each run takes only the files it has not seen."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from aisleframe.operators.clean import clean
from aisleframe.sources.raw import read_with_schema

log = logging.getLogger(__name__)

RAW_COLUMNS = ["supermarket", "prices_(£)", "prices_unit_(£)", "unit", "names", "date", "category", "own_brand"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
#: Files of one batch, whose names the driver holds; a run takes as many batches as there are new files.
FILES_PER_BATCH = 1_000
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_new_files(
    spark: SparkSession,
    raw_dir: str,
    output: str,
    checkpoint: str,
    schema: T.StructType = RAW_SCHEMA,
    max_files_per_batch: int = FILES_PER_BATCH,
) -> int:
    """Clean the new files into the output table and return how many rows were read.

    The stream carries file names only (contents are not read for them); each
    batch then reads its files by their own headers. A batch is one partition
    ``ingest_batch`` of the table and overwrites it when it runs again after a
    failure, so every file counts exactly once.
    """
    rows_read: list[int] = []

    def take(batch: DataFrame, batch_id: int) -> None:
        # The names of one batch's files; max_files_per_batch bounds them.
        files = sorted(r["path"] for r in batch.collect())
        raw = read_with_schema(batch.sparkSession, files, schema)
        if raw is None:
            return
        counts = Observation()
        clean(raw, counts).write.mode("overwrite").parquet(f"{output}/ingest_batch={batch_id}")
        seen = counts.get
        rows_read.append(seen["rows_in"])
        if seen["no_price"] or seen["no_name"]:
            log.warning("batch %d: %d rows without a price and %d without a name dropped", batch_id, seen["no_price"], seen["no_name"])

    reader = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("maxFilesPerTrigger", max_files_per_batch)
    stream = (
        reader.load(raw_dir)
        .select("path")
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return sum(rows_read)
