"""The cleaned and annotated tables: layout on write, pruning on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.functions.scalar import one_decimal, parse_distance, parse_flag
from lapforge.schema import META_SCHEMA, METRIC_COLUMNS, METRICS_SCHEMA, SESSION_KEYS

MAX_FILE_ROWS = 20_000_000


def write_sessions(df: DataFrame, path: str, order: list[str], mode: str = "overwrite",
                   partitions: list[str] = SESSION_KEYS, spread: bool = True) -> None:
    """Snappy Parquet partitioned by session and sorted by driver and time inside the files.

    Partitions that occur in ``df`` are replaced, others stay. Range partitioning on the sort
    columns cuts a large session into several files, where hashing the session key would send all
    of it to one task. ``spread=False`` is for rows whose tasks are bounded already, as the ordered
    scan of the cleaning job leaves them: they are sorted where they are and not moved again.
    """
    columns = list(dict.fromkeys([*partitions, "Driver", *order]))
    placed = df.repartitionByRange(*columns) if spread else df
    (placed.sortWithinPartitions(*columns)
       .write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", MAX_FILE_ROWS)
       .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """A stored table. Keys that are folder names are read as the texts they were, "07" included."""
    schema = spark.read.parquet(path).schema
    for field in schema:
        if field.name in ("Session", "Driver"):
            field.dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when nothing has been stored yet."""
    return read_lake(spark, path) if path_exists(spark, path) else None


def ledger_path(lake: str) -> str:
    """The run ledger of a lake: a hidden folder beside its partitions."""
    return f"{lake.rstrip('/')}/_ledger"


def write_ledger(entries: DataFrame, lake: str) -> None:
    """Add one row per finished session."""
    entries.write.mode("append").parquet(ledger_path(lake))


def read_ledger(spark: SparkSession, lake: str) -> DataFrame | None:
    """The latest entry of every finished session, or None where no run has kept a ledger."""
    if not path_exists(spark, ledger_path(lake)):
        return None
    entries = spark.read.parquet(ledger_path(lake))
    return entries.groupBy("session_file").agg(
        F.max_by(F.struct(*entries.columns), "cleaned_at").alias("entry")).select("entry.*")


def write_meta(meta: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON document per (session, driver) run."""
    meta.write.mode(mode).json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest document of every session and driver."""
    if not path_exists(spark, path):
        return None
    documents = spark.read.schema(META_SCHEMA).json(path)
    latest = documents.groupBy("session_file", "driver").agg(
        F.max_by(F.struct(*documents.columns), F.coalesce("timestamp", F.lit(""))).alias("latest"))
    return latest.select("latest.*")


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Frame metrics as CSV with header, one folder per video."""
    # range partitioning keeps the files per video few and cuts a long video into several
    (metrics.withColumn("has_curb", F.initcap(F.col("has_curb").cast("string")))
     .select("video", *METRIC_COLUMNS).repartitionByRange("video", "frame_number")
     .sortWithinPartitions("video", "frame_number").write.mode(mode).option("header", True)
     .partitionBy("video").csv(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """Frame metrics with ``has_curb`` as boolean and the distance as a number."""
    if not path_exists(spark, path):
        return None
    return clean_metrics(spark.read.schema(METRICS_SCHEMA.add("video", "string"))
                         .option("header", True).csv(path))


def clean_metrics(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "has_curb": parse_flag(F.col("has_curb")), "distance_px": parse_distance(F.col("distance_px")),
    })


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Annotated rows as CSV, no index."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def report_text(selection: DataFrame) -> DataFrame:
    """Text report per selected session and driver.

    Needs session_label, Year, driver_name, Driver, total_rows, top_speed and output_file
    (NULL when the anomaly job has not run).
    """
    lines = F.concat_ws(
        "\n", F.lit("Session Report"), F.lit("=" * 40),
        F.concat(F.lit("Session: "), F.col("session_label")),
        F.concat(F.lit("Year: "), F.col("Year").cast("string")),
        F.concat(F.lit("Driver: "), F.col("driver_name"), F.lit(" (#"), F.col("Driver"), F.lit(")")),
        F.concat(F.lit("Total rows: "), F.col("total_rows").cast("string")),
        F.concat(F.lit("Top Speed: "), one_decimal(F.col("top_speed")), F.lit(" km/h")),
        F.concat(F.lit("Mistake parquet: "), F.col("output_file")),
    )
    return selection.withColumn("report", lines)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    reports.select("report").write.mode(mode).option("lineSep", "\n\n").text(path)
