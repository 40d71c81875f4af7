"""Column contracts of the telemetry tables and the projections that enforce them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.config import DEFAULT_GEAR, UNKNOWN_DRIVER

NANOS = 1_000_000_000

# --- Fixed values: column lists of the data model -------------------------------------------
LANDING_COLUMNS = [
    "Date", "SessionTime", "Speed", "RPM", "nGear", "Throttle", "Brake",
    "X", "Y", "Z", "Driver", "Round", "Session", "Year",
]
EXPECTED_COLUMNS = [
    "Driver", "Speed", "RPM", "Throttle", "Brake", "X", "Y", "Time", "SessionTime", "nGear",
]
REQUIRED_COLUMNS = [
    "Driver", "Speed", "RPM", "Throttle", "Brake", "X", "Y", "SessionTime", "nGear",
]
CORE_CHANNELS = ["Speed", "RPM", "X", "Y"]
FEATURE_COLUMNS = [
    "speed_normalized", "throttle_intensity", "brake_intensity", "brake_throttle_overlap",
    "speed_delta", "gear_change", "rpm_normalized",
]
CHART_CHANNELS = ["Speed", "Throttle", "Brake", "nGear", "RPM"]
METRIC_COLUMNS = ["frame_number", "timestamp_sec", "distance_px", "status", "has_curb"]
TELEMETRY_TYPES = {
    "Date": "timestamp_ntz", "SessionTime": "bigint", "Time": "bigint", "Speed": "double",
    "RPM": "double", "nGear": "int", "Throttle": "double", "Brake": "double", "X": "double",
    "Y": "double", "Z": "double", "Driver": "string", "Round": "int", "Session": "string",
    "Year": "int",
}
META_SCHEMA = T.StructType([
    T.StructField("session_file", T.StringType()),
    T.StructField("driver", T.StringType()),
    T.StructField("reference_driver", T.StringType()),
    T.StructField("reference_file", T.StringType()),
    T.StructField("best_contamination", T.DoubleType()),
    T.StructField("cv_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("best_cv_score", T.DoubleType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("total_mistakes", T.LongType()),
    T.StructField("mistake_rate_pct", T.DoubleType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.StringType()),
])
# --------------------------------------------------------------------------------------------

SESSION_KEYS = ["Year", "Round", "Session"]
DRIVER_KEYS = SESSION_KEYS + ["Driver"]
FILE_ORDER = ["part_file", "row_index"]
PANDAS_INDEX = "__index_level_0__"

METRICS_SCHEMA = T.StructType([
    T.StructField("frame_number", T.IntegerType()),
    T.StructField("timestamp_sec", T.DoubleType()),
    T.StructField("distance_px", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("has_curb", T.StringType()),
])


class MissingColumnsError(ValueError):
    """The table lacks columns the job cannot do without."""


def keep_existing(df: DataFrame, wanted: list[str] = LANDING_COLUMNS) -> DataFrame:
    """Project onto those of ``wanted`` that the table has, in that order."""
    return df.select(*[c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"the table has no column {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN apart from NULL; the sensor data means NULL by both."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in df.columns if c in floating
    })


def repair_columns(df: DataFrame, position: str = "row_index", fill_channels: bool = True) -> DataFrame:
    """Add expected columns the table lacks.

    Times become the physical row position in seconds (as nanoseconds), so ``position`` has to be
    taken before any row is dropped. ``fill_channels=False`` leaves absent sensor channels out,
    which is how the read path behaves; the cleaning path fills them with zero.
    """
    added = {}
    for name in EXPECTED_COLUMNS:
        if name in df.columns:
            continue
        if name == "Driver":
            added[name] = F.lit(UNKNOWN_DRIVER)
        elif name in ("Time", "SessionTime"):
            added[name] = F.col(position).cast("bigint") * F.lit(NANOS).cast("bigint")
        elif name == "nGear":
            added[name] = F.lit(DEFAULT_GEAR)
        elif fill_channels:
            added[name] = F.lit(0.0)
    return df.withColumns(added) if added else df


def conform(df: DataFrame) -> DataFrame:
    """Drop the pandas index, cast known columns to the model types and turn NaN into NULL."""
    casts = {
        c: F.col(c).cast(TELEMETRY_TYPES[c])
        for c in df.columns
        if c in TELEMETRY_TYPES and df.schema[c].dataType.simpleString() != TELEMETRY_TYPES[c]
    }
    if "Date" in casts and isinstance(df.schema["Date"].dataType, T.LongType):
        casts["Date"] = F.timestamp_micros(F.expr("`Date` div 1000")).cast("timestamp_ntz")
    out = df.drop(PANDAS_INDEX)
    return nan_to_null(out.withColumns(casts) if casts else out)
