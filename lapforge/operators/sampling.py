"""Order, position and thinning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.config import CHART_POINTS
from lapforge.operators.ordered import MAX_GROUP_ROWS, Timeline

FRAME_BLOCK = 100_000


def downsample(df: DataFrame | Timeline, keys: list[str], order: list[str], max_points: int = CHART_POINTS,
               strict: bool = False, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Every step-th row of each group plus its last row; groups within the limit stay whole.

    The step is the floor of size / max_points, so almost twice ``max_points`` rows can remain;
    ``strict=True`` rounds the step up and stays within max_points + 1. Rows that lie on a timeline in that order
    are not moved again.
    """
    if isinstance(df, Timeline):
        if df.order != order:
            raise ValueError(f"the timeline is ordered by {df.order}, not {order}")
        timeline = df.by(keys)
    else:
        timeline = Timeline.of(df, keys, order, max_group_rows)
    placed = timeline.positions("_pos", "_n").result()
    limit = F.lit(max_points).cast("bigint")
    step = F.expr(f"_n div {int(max_points)}")
    if strict:
        step = F.ceil(F.col("_n") / limit)
    keep = (F.col("_n") <= limit) | (F.col("_pos") % F.greatest(step, F.lit(1)) == 0) | (
        F.col("_pos") == F.col("_n") - 1)
    return placed.where(keep).drop("_pos", "_n")


def select_frames(frames: DataFrame, per_video: int, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Up to ``per_video`` evenly spread frames of every (year, video), in name order."""
    placed = Timeline.of(frames, ["year", "video"], ["frame_name"], max_group_rows).positions(
        "_pos", "_n").result()
    step = F.greatest(F.lit(1), F.expr(f"_n div {int(per_video)}"))
    chosen = (F.col("_pos") % step == 0) & (F.col("_pos") / step < per_video)
    return placed.where(chosen).withColumn(
        "selected_name", F.concat_ws("_", F.col("year").cast("string"), "video", "frame_name")
    ).drop("_pos", "_n")


def sample_video_frames(videos: DataFrame, target_fps: int) -> DataFrame:
    """Frames kept at the target rate, numbered from 1 in the order they are saved.

    Kept frame k is frame k * interval, so the running number needs no window. The list of a long
    video is produced in blocks and never sits in one row.
    """
    interval = F.when(F.col("fps") > 0, F.greatest(
        F.lit(1), (F.col("fps") / F.lit(target_fps)).cast("bigint"))).otherwise(F.lit(1)).cast("bigint")
    sized = videos.withColumn("frame_interval", interval).withColumn(
        "_kept", F.expr("(total_frames + frame_interval - 1) div frame_interval")
    ).where(F.col("_kept") > 0)
    blocks = sized.withColumn("_block", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_kept - 1) div {FRAME_BLOCK}"))))
    kept = blocks.withColumn("_k", F.explode(F.sequence(
        F.col("_block") * FRAME_BLOCK,
        F.least(F.col("_kept"), (F.col("_block") + 1) * FRAME_BLOCK) - 1)))
    return kept.withColumns({
        "frame_number": F.col("_k") * F.col("frame_interval"),
        "saved_number": F.col("_k") + 1,
        "file_name": F.format_string("frame_%05d.jpg", F.col("_k") + 1),
    }).drop("_kept", "_block", "_k")


def sort_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Total order: keys, then session time, then the tie breaker."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in keys + order])
