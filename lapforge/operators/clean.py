"""Cleaning of raw telemetry: drop dead packets, forward fill, clip, downcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.config import MAX_BRAKE, MAX_RPM, MAX_SPEED, MAX_THROTTLE
from lapforge.operators.ordered import MAX_GROUP_ROWS, Timeline
from lapforge.schema import CORE_CHANNELS, FILE_ORDER

CLIP_LIMITS = {
    "Speed": (0.0, MAX_SPEED), "RPM": (0.0, MAX_RPM),
    "Throttle": (0.0, MAX_THROTTLE), "Brake": (0.0, MAX_BRAKE),
}
FLOAT_CHANNELS = ["Speed", "RPM", "Throttle", "Brake", "X", "Y"]


def clamp(value: Column, low, high) -> Column:
    """Clip that keeps NULL: ``greatest``/``least`` alone would turn it into a bound."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def drop_dead_packets(df: DataFrame) -> DataFrame:
    """Rows whose core channels are all NULL carry no telemetry."""
    return df.na.drop(how="all", subset=[c for c in CORE_CHANNELS if c in df.columns])


def clip_outliers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: clamp(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in CLIP_LIMITS.items() if c in df.columns
    })


def downcast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in FLOAT_CHANNELS if c in df.columns})


def numeric_columns(df: DataFrame, leave: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def forward_fill(df: DataFrame, file_keys: list[str], order: list[str], scope: str = "file",
                 columns: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                 measured_on: DataFrame | None = None) -> DataFrame:
    return fill_timeline(df, file_keys, order, scope, columns, max_group_rows, measured_on).result()


def fill_timeline(df: DataFrame, file_keys: list[str], order: list[str], scope: str = "file",
                  columns: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                  measured_on: DataFrame | None = None) -> Timeline:
    """Fill gaps with the last known value in physical row order.

    ``scope="file"`` fills across the whole file, drivers included; ``scope="driver"`` stops at
    the driver. An order of exactly (part_file, row_index) is recognised as the files' own order.
    """
    if scope not in ("file", "driver"):
        raise ValueError(f"unknown fill scope: {scope}")
    keys = file_keys if scope == "file" else file_keys + ["Driver"]
    columns = columns or numeric_columns(df, leave=file_keys + order)
    if order == FILE_ORDER:
        timeline = Timeline.by_file_position(df, keys, *order, max_group_rows, measured_on)
    else:
        timeline = Timeline.of(df, keys, order, max_group_rows, measured_on)
    return timeline.carry({c: F.col(c) for c in columns})


def clean(df: DataFrame, file_keys: list[str], order: list[str], scope: str = "file",
          columns: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The cleaning chain on repaired rows: drop, fill, clip, downcast."""
    return clean_timeline(df, file_keys, order, scope, columns, max_group_rows).result()


def clean_timeline(df: DataFrame, file_keys: list[str], order: list[str], scope: str = "file",
                   columns: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> Timeline:
    """The same on the layout of the fill, for ordered steps that follow."""
    # the raw rows are counted from the file footers, the remaining ones would take a scan
    filled = fill_timeline(drop_dead_packets(df), file_keys, order, scope, columns, max_group_rows, df)
    return filled.replace(downcast(clip_outliers(filled.rows)))


def dropped_rows(df: DataFrame, file_keys: list[str]) -> DataFrame:
    """Raw, kept and dropped row counts per file."""
    dead = None
    for c in CORE_CHANNELS:
        dead = F.col(c).isNull() if dead is None else dead & F.col(c).isNull()
    return df.groupBy(*file_keys).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(dead).alias("rows_dropped"),
    ).withColumn("row_count", F.col("raw_rows") - F.col("rows_dropped"))
