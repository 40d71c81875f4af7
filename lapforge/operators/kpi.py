"""Session, driver and video aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.functions import geometry as G
from lapforge.functions.scalar import lap_text, round_cents
from lapforge.operators.features import pedal_overlap
from lapforge.operators.ordered import join_summary
from lapforge.schema import DRIVER_KEYS, SESSION_KEYS


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key of an already aggregated (small) table."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reference_drivers(df: DataFrame, keys: list[str] = SESSION_KEYS) -> DataFrame:
    """Driver with the highest mean speed per session, the smaller code on a tie."""
    means = df.groupBy(*keys, "Driver").agg(F.avg("Speed").cast("float").alias("mean_speed"))
    return fastest_of(means, keys)


def fastest_of(means: DataFrame, keys: list[str] = SESSION_KEYS) -> DataFrame:
    """The same from one row per driver with ``mean_speed``."""
    best = first_by(means.where("Driver is not null and mean_speed is not null").select(*keys, "Driver", "mean_speed"), keys,
                    [F.col("mean_speed").desc(), F.col("Driver").asc()])
    return best.withColumnRenamed("Driver", "reference_driver")


def brake_overlap_pct() -> Column:
    """Share of rows with both pedals touched at all."""
    return F.avg(pedal_overlap(0.0).cast("int")) * 100


def perfect_corner_score() -> Column:
    """100 minus the share of rows with both pedals beyond the noise threshold."""
    return F.lit(100.0) - F.avg(pedal_overlap().cast("int")) * 100


def session_time() -> Column:
    """Seconds of the session clock; the per-row clock where the session clock is missing."""
    return F.col("SessionTime") / F.lit(1e9)


def choose_time(df: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    """Add ``session_s``: SessionTime unless a driver has none at all, then Time."""
    if "SessionTime" not in df.columns:
        return df.withColumn("session_s", F.col("Time") / F.lit(1e9))
    if "Time" not in df.columns:
        return df.withColumn("session_s", session_time())
    known = df.groupBy(*keys).agg((F.count("SessionTime") > 0).alias("_has_clock"))
    return join_summary(df, known, keys).withColumn(
        "session_s", F.when(F.col("_has_clock"), session_time()).otherwise(F.col("Time") / F.lit(1e9))
    ).drop("_has_clock")


def driver_kpis(df: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    """Row count, top speed, time range and pedal scores in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.max("Speed").cast("double"), F.lit(0.0)).alias("top_speed"),
        F.min(session_time()).alias("min_t"), F.max(session_time()).alias("max_t"),
        brake_overlap_pct().alias("brake_overlap_pct"),
        perfect_corner_score().alias("perfect_corner_score"),
    )


def mistake_rate(mistakes: Column, total: Column) -> Column:
    return F.when(total > 0, round_cents(mistakes / total * 100)).otherwise(F.lit(0.0))


def _mistake_counts() -> list[Column]:
    flagged = F.col("is_mistake")
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(flagged).alias("total_mistakes"),
        F.count_if(flagged & (F.col("brake_intensity") > 0.5)).alias("brake_override"),
        F.count_if(flagged & (F.col("throttle_intensity") < 0.2)
                   & (F.col("speed_delta") < -5)).alias("throttle_slip"),
    ]


def mistake_summary(annotated: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    """Mistake counts, the two named kinds and the mistake rate."""
    return annotated.groupBy(*keys).agg(*_mistake_counts()).withColumn(
        "mistake_rate_pct", mistake_rate(F.col("total_mistakes"), F.col("total_rows")))


def driver_facts(annotated: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    """The mistake summary with top and mean speed: all that panels, reports and the reference choice need, in one pass."""
    return annotated.groupBy(*keys).agg(
        *_mistake_counts(), F.coalesce(F.max("Speed").cast("double"), F.lit(0.0)).alias("top_speed"),
        F.avg("Speed").cast("float").alias("mean_speed"),
    ).withColumn("mistake_rate_pct", mistake_rate(F.col("total_mistakes"), F.col("total_rows")))


def video_summary(metrics: DataFrame) -> DataFrame:
    """Apex status counts, curb frames and apex accuracy per video."""
    counted = metrics.groupBy("video").agg(
        F.count_if(F.col("status") == G.HITTING).alias("hitting"),
        F.count_if(F.col("status") == G.NEAR).alias("near"),
        F.count_if(F.col("status") == G.MISSING).alias("missing"),
        F.count_if("has_curb").alias("curb_frames"),
    )
    return counted.withColumn(
        "apex_accuracy_pct",
        (F.col("hitting") + F.col("near")) / F.nullif(F.col("curb_frames"), F.lit(0)) * 100)


def fastest_laps(laps: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    return laps.groupBy(*keys).agg(F.min("LapTime").alias("fastest_lap")).withColumn(
        "lap_time", F.coalesce(lap_text(F.col("fastest_lap")), F.lit("—")))


def season_rounds(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("Year").agg(F.max("RoundNumber").alias("max_round"))


def contamination_scores(fold_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over folds, best contamination (first on ties) and the score map.

    ``fold_scores`` has one row per key, fold and contamination. Scores are compared after
    rounding, so that noise in the last digits does not decide a tie.
    """
    means = fold_scores.groupBy(*keys, "contamination").agg(F.avg("fold_score").alias("cv_score"))
    ranked = F.struct(-F.round("cv_score", 10), F.col("contamination"))
    entry = F.struct(F.col("contamination"), F.col("cv_score"))
    return means.groupBy(*keys).agg(
        F.min_by(entry, ranked).alias("_best"),
        F.array_sort(F.collect_list(entry)).alias("_scores"),  # one entry per grid value
    ).select(
        *keys, F.col("_best.contamination").alias("best_contamination"),
        F.col("_best.cv_score").alias("best_cv_score"),
        F.map_from_entries(F.transform("_scores", lambda e: F.struct(
            e["contamination"].cast("string"), e["cv_score"]))).alias("cv_scores"),
    )
