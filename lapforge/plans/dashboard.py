"""What a dashboard selection needs, as DataFrames over all sessions and drivers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.config import CHART_POINTS, MAP_POINTS
from lapforge.functions import scalar as S
from lapforge.operators import kpi as K
from lapforge.operators import lookup as L
from lapforge.operators.ordered import Timeline, join_summary
from lapforge.operators.sampling import downsample
from lapforge.schema import CHART_CHANNELS, DRIVER_KEYS, SESSION_KEYS


def session_options(stems: DataFrame, schedule: DataFrame) -> DataFrame:
    """Readable label and sort round of every session stem; what is no session keeps its stem."""
    parts = S.stem_parts(F.col("stem"))
    named = F.size(parts) == 3
    keyed = stems.withColumns({
        "Year": F.when(named, parts[0].try_cast("int")), "Round": F.when(named, parts[1].try_cast("int")),
        "Session": F.when(named, parts[2])})
    looked_up = L.with_session_labels(L.with_event_names(keyed, schedule))
    return looked_up.select(
        "stem", S.session_option(F.col("stem"), F.col("EventName"), F.col("session_label")).alias("label"),
    ).withColumns({
        "sort_round": S.option_round(F.col("label")),
        "header_round": S.header_round(F.col("stem")), "header_session": S.header_session(F.col("stem")),
    })


def driver_options(telemetry: DataFrame) -> DataFrame:
    """Distinct drivers per session as "Name (#number)", ranked by name."""
    found = telemetry.select(*DRIVER_KEYS).where(F.col("Driver").isNotNull()).distinct()
    named = L.with_driver_names(found)
    by_name = Window.partitionBy(*SESSION_KEYS).orderBy("driver_name", "Driver")  # drivers only, no rows
    return named.select(
        *DRIVER_KEYS, F.concat("driver_name", F.lit(" (#"), "Driver", F.lit(")")).alias("label"),
        F.row_number().over(by_name).cast("bigint").alias("option_rank"))


def header_bar(telemetry: DataFrame, laps: DataFrame, meta: DataFrame) -> DataFrame:
    """One KPI row per session and driver; a dash where the anomaly job or the laps have nothing.

    ``telemetry``: cleaned rows, or one row per driver with ``top_speed`` (``kpi.driver_facts``), which spares a scan.
    """
    if "top_speed" in telemetry.columns:
        top = telemetry.select(*DRIVER_KEYS, F.col("top_speed").alias("_top"))
    else:
        top = telemetry.groupBy(*DRIVER_KEYS).agg(F.coalesce(F.max("Speed").cast("double"), F.lit(0.0)).alias("_top"))
    wide = join_summary(join_summary(top, K.fastest_laps(laps).drop("fastest_lap"), DRIVER_KEYS), meta.select(
        *DRIVER_KEYS, "mistake_rate_pct", "total_mistakes", "reference_driver", "best_contamination"), DRIVER_KEYS)
    named = L.with_team_names(L.with_driver_names(L.with_driver_names(
        wide, F.col("reference_driver"), key="reference_driver", name="_reference")))
    dash = F.lit(S.DASH)
    return named.select(
        *DRIVER_KEYS, F.coalesce("lap_time", dash).alias("lap_time"),
        F.concat(S.one_decimal(F.col("_top")), F.lit(" km/h")).alias("top_speed"),
        F.coalesce(S.percent_text(F.col("mistake_rate_pct")), dash).alias("mistake_rate"),
        F.coalesce(F.col("total_mistakes").cast("string"), dash).alias("mistakes"),
        F.coalesce("_reference", dash).alias("reference"),
        F.coalesce(F.col("best_contamination").cast("string"), dash).alias("contamination"),
        F.upper("driver_name").alias("driver_title"), "team_name")


def telemetry_series(telemetry: DataFrame, drivers: list[str], until_s: float, order: list[str],
                     max_points: int = CHART_POINTS) -> DataFrame:
    """Chart series of one or two drivers up to the scrub time, thinned per driver."""
    chosen = telemetry.where(F.col("Driver").isin(drivers))
    timed = K.choose_time(chosen).where(F.col("session_s") <= until_s)
    thin = downsample(timed, DRIVER_KEYS, order, max_points)
    return thin.withColumns({c: F.col(c).cast("double") for c in CHART_CHANNELS}).withColumn(
        "role", F.when(F.col("Driver") == drivers[0], "primary").otherwise("compare")
    ).unpivot([*DRIVER_KEYS, "role", "session_s"], CHART_CHANNELS, "channel", "value")


def track_map(rows: DataFrame | Timeline, order: list[str], mode: str = "speed", max_points: int = MAP_POINTS) -> DataFrame:
    """Map points coloured by speed or by anomaly score."""
    if mode not in ("speed", "mistakes"):
        raise ValueError(f"unknown map mode: {mode}")
    color = "Speed" if mode == "speed" else "anomaly_score"
    thin = downsample(rows, DRIVER_KEYS, order, max_points)
    return thin.select(*DRIVER_KEYS, "SessionTime", "X", "Y", F.col(color).alias("color"))


def mistake_points(annotated: DataFrame) -> DataFrame:
    """Flagged rows, never thinned."""
    return annotated.where("is_mistake").select(
        *DRIVER_KEYS, "SessionTime", "X", "Y", "Speed", "anomaly_score")


def ai_summary(annotated: DataFrame | None, meta: DataFrame) -> DataFrame:
    """Anomaly counts and the caption of the analysis panel; without annotated rows, ``meta`` holds the two named kinds."""
    known = meta
    if annotated is not None:
        kinds = K.mistake_summary(annotated).select(*DRIVER_KEYS, "brake_override", "throttle_slip")
        known = join_summary(meta.drop("brake_override", "throttle_slip"), kinds, DRIVER_KEYS, "inner")
    named = L.with_driver_names(known, F.col("reference_driver"), key="reference_driver", name="_reference")
    return named.withColumns({
        "caption": F.format_string("contamination=%.2f · %d anomalies (%s) · ref: %s", "best_contamination",
                                   "total_mistakes", S.percent_text(F.col("mistake_rate_pct")), "_reference"),
        "kfold_score": F.format_string("%.4f", "best_cv_score"),
    }).drop("_reference")


def score_bars(meta: DataFrame) -> DataFrame:
    """One bar per grid value, the chosen one marked."""
    bars = meta.select(*DRIVER_KEYS, "best_contamination", F.explode("cv_scores").alias("_grid", "cv_score"))
    return bars.withColumn("contamination", F.col("_grid").cast("double")).withColumn(
        "is_best", F.abs(F.col("contamination") - F.col("best_contamination")) < 1e-6).drop("_grid")
