"""Incremental cleaning: every landed session file is processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.operators.clean import clean
from lapforge.plans.season import ledger_entries
from lapforge.schema import FILE_ORDER
from lapforge.sources.lake import write_ledger, write_sessions
from lapforge.sources.telemetry import FILE_KEYS, list_files, read_sessions, session_stem


def clean_new_files(spark: SparkSession, landing: str, lake: str, ledger: str, scope: str = "file") -> int:
    """Clean what has landed since the last run into ``lake``; returns the number of batches.

    The stream carries file names only. Its checkpoint (``ledger``) is the list of files done, so a
    second run without new files adds no batch. A session is cleaned as a whole, with all of its
    files that have landed, and replaces its own partition: replaying a batch is harmless, and a
    late part file of a session completes it. The lake's run ledger gets a row per session cleaned.
    """
    files = (spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(landing)
        .select("path", "length"))

    batches = []  # progress reports keep the last hundred only

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batches.append(batch_id)
        touched = batch.where("length > 0").select(session_stem(F.col("path")).alias(FILE_KEYS[0])).distinct()
        if touched.isEmpty():
            return
        session = batch.sparkSession
        landed = list_files(session, landing).withColumn(FILE_KEYS[0], session_stem(F.col("path")))
        files = landed.where("length > 0").join(touched, FILE_KEYS, "left_semi")
        raw = read_sessions(session, files, landing=True)
        write_sessions(clean(raw, FILE_KEYS, FILE_ORDER, scope), lake, ["SessionTime", *FILE_ORDER], spread=False)
        write_ledger(ledger_entries(raw, files), lake)

    stream = (files.writeStream.foreachBatch(run).option("checkpointLocation", ledger)
              .trigger(availableNow=True).start())
    stream.awaitTermination()
    return len(batches)
