"""Per-frame reduction of segmenter detections to apex metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.config import CURB_CLASS, MIN_CONFIDENCE, Settings
from lapforge.functions import geometry as G
from lapforge.functions.scalar import distance_text, frame_seconds

DEFAULTS = Settings()
FRAME_KEYS = ["video", "frame_number"]


def confident(detections: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    return detections.where(F.col("confidence") >= minimum)


def measure_curbs(detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Turn direction, wheel and nearest distance of every curb detection."""
    left, right = G.wheel_positions(F.col("width"), F.col("height"), settings)
    sided = detections.where(F.col("class_id") == CURB_CLASS).withColumn(
        "contour", G.largest_contour(F.col("contours"))
    ).withColumn("_moments", G.moments(F.col("contour"))  # kept as a column: computed once
    ).withColumn("cx", G.centroid_x(F.col("_moments"))).drop("_moments")
    is_right = F.col("cx") > F.expr("width div 2")
    return sided.withColumns({
        "turn": F.when(F.col("cx").isNotNull(), F.when(is_right, "Right").otherwise("Left")),
        "wheel": F.when(F.col("cx").isNotNull(), F.when(is_right, right).otherwise(left)),
    }).withColumn("hit", F.when(
        F.col("cx").isNotNull(), G.nearest_point(F.col("wheel"), F.col("contour"))))


def reduce_frames(curbs: DataFrame) -> DataFrame:
    """One row per frame: nearest curb (first of equals) but the turn of the last usable curb."""
    usable = F.col("cx").isNotNull()
    nearest = F.struct(F.col("hit.distance"), F.col("det_idx"), F.col("hit.point"), F.col("wheel"))
    last = F.struct(F.col("det_idx"), F.col("turn"))
    return curbs.groupBy(*FRAME_KEYS).agg(
        F.min(F.when(usable, nearest)).alias("best"), F.max(F.when(usable, last)).alias("last"),
    ).select(
        *FRAME_KEYS, F.col("best.distance").alias("distance"), F.col("best.point").alias("closest_point"),
        F.col("best.wheel").alias("wheel"), F.col("last.turn").alias("turn_direction"),
        F.lit(True).alias("has_curb"))


def frame_metrics(frames: DataFrame, detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Metric row of every frame, frames without any curb included.

    ``frames`` holds (video, frame_number, fps); the result has the columns of the metrics file.
    """
    reduced = reduce_frames(measure_curbs(confident(detections), settings))
    joined = frames.join(reduced, FRAME_KEYS, "left").withColumns({
        "has_curb": F.coalesce("has_curb", F.lit(False)),
        "turn_direction": F.coalesce("turn_direction", F.lit(G.STRAIGHT)),
    })
    return joined.withColumns({
        "timestamp_sec": frame_seconds(F.col("frame_number"), F.col("fps")),
        "distance_px": distance_text(F.col("distance"), F.col("has_curb")),
        "status": G.apex_status(F.col("distance"), F.col("has_curb"), settings),
    })
