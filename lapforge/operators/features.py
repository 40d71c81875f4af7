"""The seven driving features fed to the anomaly model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.config import (
    GEAR_CHANGE_LIMIT, MAX_BRAKE, MAX_RPM, MAX_SPEED, MAX_THROTTLE, PEDAL_THRESHOLD,
    SPEED_DELTA_LIMIT,
)
from lapforge.operators.ordered import MAX_GROUP_ROWS, Timeline
from lapforge.schema import DRIVER_KEYS


def pedal_overlap(threshold: float = PEDAL_THRESHOLD) -> Column:
    """Brake and throttle both pressed beyond the threshold; NULL pedals count as released."""
    both = (F.col("Brake") > F.lit(threshold)) & (F.col("Throttle") > F.lit(threshold))
    return F.coalesce(both, F.lit(False))


def scaled(column: str, limit: float) -> Column:
    return (F.col(column) / F.lit(limit)).cast("float")


def engineer_features(df: DataFrame | Timeline, keys: list[str] = DRIVER_KEYS,
                      order: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Append the features; deltas look at the driver's previous row in session-time order.

    Rows that lie on a timeline of wider groups in that order (``clean_timeline``) are not moved again.
    """
    return feature_timeline(df, keys, order, max_group_rows).result()


def feature_timeline(df: DataFrame | Timeline, keys: list[str] = DRIVER_KEYS,
                     order: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> Timeline:
    """The same on the drivers' timeline, for ordered steps that follow."""
    order = order or ["SessionTime", "row_index"]
    if isinstance(df, Timeline):
        if df.order != order:
            raise ValueError(f"the timeline is ordered by {df.order}, not {order}")
        timeline = df.by(keys)
    else:
        timeline = Timeline.of(df, keys, order, max_group_rows)
    stepped = timeline.previous({"_speed": F.col("Speed"), "_gear": F.col("nGear")})
    speed_step = F.coalesce((F.col("Speed") - F.col("_speed")).cast("float"), F.lit(0.0))
    gear_step = F.coalesce(F.abs(F.col("nGear") - F.col("_gear")), F.lit(0))
    return stepped.replace(stepped.rows.withColumns({
        "speed_normalized": scaled("Speed", MAX_SPEED),
        "throttle_intensity": scaled("Throttle", MAX_THROTTLE),
        "brake_intensity": scaled("Brake", MAX_BRAKE),
        "brake_throttle_overlap": pedal_overlap().cast("float"),
        "speed_delta": F.greatest(
            F.lit(-SPEED_DELTA_LIMIT), F.least(F.lit(SPEED_DELTA_LIMIT), speed_step)).cast("float"),
        "gear_change": F.least(F.lit(GEAR_CHANGE_LIMIT), gear_step).cast("float"),
        "rpm_normalized": scaled("RPM", MAX_RPM),
    }).drop("_speed", "_gear"))
