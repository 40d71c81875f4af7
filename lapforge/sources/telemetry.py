"""Reading session files as they come: one Parquet file per session, schemas not uniform."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.config import DEFAULT_GEAR, SEASON_FALLBACK_ROUNDS, UNKNOWN_DRIVER
from lapforge.functions.scalar import stem_parts
from lapforge.operators.ordered import join_summary
from lapforge.schema import EXPECTED_COLUMNS, NANOS, conform, keep_existing, repair_columns

FILE_KEYS = ["session_file"]  # what one fill scope and one skip decision cover
ABSENT = -(1 << 63) + 1       # a time that no file holds


def list_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, length, modificationTime) of every file below ``path``; file contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime"))


def session_stem(path: Column) -> Column:
    """Session a file belongs to: its stem, or the folder's when a session has several part files."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    owner = F.when(name.startswith("part-"), F.element_at(parts, -2)).otherwise(name)
    return F.regexp_replace(owner, r"^session_file=|\.parquet$", "")


def part_name(name: Column) -> Column:
    """A part file's name with its number padded, so that parts sort by number."""
    number = F.regexp_extract(name, r"^part-(\d+)", 1)
    rest = F.regexp_replace(name, r"^part-\d+", "")
    return F.when(number != "", F.concat(F.lit("part-"), F.lpad(number, 12, "0"), rest)).otherwise(name)


def rows_before(groups: list[DataFrame]) -> DataFrame:
    """(session_file, part_file, _before): rows in the earlier parts of a session; one row per file."""
    counts = None
    for rows in groups:
        own = rows.groupBy("session_file", "part_file").agg(F.count(F.lit(1)).alias("_rows"))
        counts = own if counts is None else counts.union(own)
    ahead = Window.partitionBy("session_file").orderBy("part_file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("session_file", "part_file", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))


def lake_size(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Size of everything below a folder, as "12.34 MB"."""
    total = F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1024.0 * 1024.0)
    return list_files(spark, path, glob).agg(F.format_string("%.2f MB", total).alias("lake_size"))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Schema text of each Parquet file, read from its footer."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        schemas = []
        for uri in batch["path"]:
            # local paths are listed as file:/x, which the Arrow file systems do not take
            fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
            fields = pq.read_schema(inner, filesystem=fs)
            schemas.append(";".join(sorted(f"{f.name}:{f.type}" for f in fields)))
        yield pd.DataFrame({"path": batch["path"], "schema_text": schemas})


def schema_groups(files: DataFrame) -> list[list[str]]:
    """Files grouped by identical schema, for files whose column types differ.

    The footers are read by the executors. The driver receives one path per file, which is no more
    than the file index Spark itself keeps for the scan.
    """
    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    grouped: dict[str, list[str]] = {}
    for row in spread.mapInPandas(_footers, "path string, schema_text string").collect():
        grouped.setdefault(row["schema_text"], []).append(row["path"])
    return [sorted(paths) for _, paths in sorted(grouped.items())]


def reader(spark: SparkSession):
    # pandas stores instants in nanoseconds, which the reader only accepts as plain numbers
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")


def common_schema(spark: SparkSession, paths: list[str]) -> T.StructType | None:
    """All columns of the files, merged by a job over their footers; None where a column's type differs."""
    try:
        return reader(spark).option("mergeSchema", True).parquet(*paths).schema
    except (AnalysisException, PySparkException, Py4JJavaError) as error:
        text = str(error)
        if "PATH_NOT_FOUND" in text or "UNABLE_TO_INFER_SCHEMA" in text:
            raise FileNotFoundError(f"no session files in {paths[:3]}") from error
        if "MERGE" in text.upper():
            return None
        raise


def marked_schema(schema: T.StructType, fill_channels: bool) -> T.StructType | None:
    """``schema`` with what the scan gives for a column that a file lacks, which a NULL in a file is not: the repair
    value, or ``ABSENT`` for times. None if a column has a type that no such value is known for."""
    fields = []
    for f in schema:
        kind, default = f.dataType, None
        if f.name in ("Time", "SessionTime"):
            default = f"{ABSENT}L" if isinstance(kind, T.LongType) else ""
        elif f.name == "Driver":
            default = f"'{UNKNOWN_DRIVER}'" if isinstance(kind, T.StringType) else ""
        elif f.name == "nGear" or f.name in EXPECTED_COLUMNS and fill_channels:
            number = DEFAULT_GEAR if f.name == "nGear" else 0
            default = f"CAST({number} AS {kind.simpleString()})" if isinstance(kind, T.NumericType) else ""
        if default == "":
            return None
        fields.append(T.StructField(f.name, kind, True, {"EXISTS_DEFAULT": default} if default else {}))
    return T.StructType(fields)


def with_origin(raw: DataFrame, landing: bool) -> DataFrame:
    """Session, part file and place in it for every row; ``landing`` keeps an ingested session's columns only."""
    origin = {
        "session_file": session_stem(F.col("_metadata.file_path")),
        "part_file": part_name(F.col("_metadata.file_name")),
        "row_index": F.col("_metadata.row_index"),
    }
    rows = raw.withColumns(origin)
    return rows.select(*keep_existing(rows).columns, *list(origin)) if landing else rows


def read_sessions(spark: SparkSession, source: str | DataFrame, fill_channels: bool = True,
                  landing: bool = False) -> DataFrame:
    """All session files as one table with ``session_file`` and the files' own row order.

    Absent columns are repaired per file, though an absent column and an all-NULL column look alike in a merged
    read: the scan is given the value that stands for an absent column. ``source`` is a path, which may hold
    wildcards (``lake/2024_*`` for a year), or a listing of chosen files, whose paths go to the scan. Where a
    column's type differs between files, they are read by groups of equal schema.
    ``landing`` limits the read to the columns an ingested session keeps. Synthesized times count
    the rows of a session through all of its part files.
    """
    paths = [source] if isinstance(source, str) else [r["path"] for r in source.select("path").collect()]
    if not paths:
        raise FileNotFoundError("no session files are chosen")
    schema = common_schema(spark, paths)
    marked = None if schema is None else marked_schema(schema, fill_channels)
    if marked is None:
        return read_by_schema(spark, list_files(spark, source) if isinstance(source, str) else source.select("path"),
                              fill_channels, landing)
    rows = with_origin(reader(spark).schema(marked).parquet(*paths), landing)
    times = [c for c in ("Time", "SessionTime") if c in rows.columns]
    partly = [c for c in times if not rows.where(F.col(c) == ABSENT).isEmpty()]
    if len(times) == 2 and not partly:
        return with_session_keys(repair_columns(conform(rows), "row_index", fill_channels))
    placed = join_summary(rows, rows_before([rows]), ["session_file", "part_file"]).withColumn(
        "_position", F.col("row_index") + F.col("_before")).drop("_before")
    placed = placed.withColumns({
        c: F.when(F.col(c) == ABSENT, F.col("_position").cast("bigint") * NANOS).otherwise(F.col(c)) for c in partly})
    return with_session_keys(repair_columns(conform(placed), "_position", fill_channels)).drop("_position")


def read_by_schema(spark: SparkSession, files: DataFrame, fill_channels: bool, landing: bool) -> DataFrame:
    """The same for files whose columns differ in type: one scan per schema."""
    parts, groups = [], []
    for paths in schema_groups(files):
        groups.append(with_origin(reader(spark).parquet(*paths), landing))
    timed = {"Time", "SessionTime"}
    earlier = None if all(timed <= set(g.columns) for g in groups) else rows_before(groups)
    for rows in groups:
        if timed <= set(rows.columns):
            parts.append(with_session_keys(repair_columns(conform(rows), "row_index", fill_channels)))
        else:
            placed = rows.join(earlier, ["session_file", "part_file"]).withColumn(
                "_position", F.col("row_index") + F.col("_before")).drop("_before")
            parts.append(with_session_keys(repair_columns(conform(placed), "_position", fill_channels)).drop("_position"))
    if not parts:
        raise FileNotFoundError("no session files to read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def with_session_keys(df: DataFrame) -> DataFrame:
    """Year, Round and Session from the file stem where the file has no such columns.

    A stem of another form becomes the Session itself, so that every file keeps a key of its own.
    """
    parts = stem_parts(F.col("session_file"))
    named = F.size(parts) == 3
    wanted = {
        "Year": F.when(named, parts[0].try_cast("int")),
        "Round": F.when(named, parts[1].try_cast("int")),
        "Session": F.when(named, parts[2]).otherwise(F.col("session_file")),
    }
    return df.withColumns({k: v for k, v in wanted.items() if k not in df.columns})


def season_manifest(seasons: DataFrame, schedule: DataFrame, session_types: tuple[str, ...] = ("Q", "R"),
                    fallback_rounds: int = SEASON_FALLBACK_ROUNDS) -> DataFrame:
    """Every (Year, Round, Session) a complete lake holds: rounds up to the schedule's last."""
    rounds = schedule.groupBy("Year").agg(F.max("RoundNumber").alias("_rounds"))
    last = F.coalesce(F.col("_rounds"), F.lit(fallback_rounds))
    return (seasons.select("Year").distinct().join(rounds, "Year", "left")
            .withColumn("Round", F.explode(F.sequence(F.lit(1), last)))
            .withColumn("Session", F.explode(F.array(*[F.lit(s) for s in session_types])))
            .select("Year", "Round", "Session"))
