"""Lookups: dimensions, nearest in time, file pairing and skip-if-done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge import dims
from lapforge.operators.ordered import MAX_GROUP_ROWS, Timeline, join_summary, order_key
from lapforge.schema import SESSION_KEYS


def with_driver_names(df: DataFrame, default: Column | None = None, key: str = "Driver",
                      name: str = "driver_name") -> DataFrame:
    """Left lookup of the 24-entry driver table; ``default`` is a label or the code itself."""
    table = F.broadcast(dims.drivers(df.sparkSession).select(
        F.col("Driver").alias(key), F.col("driver_name").alias(name)))
    fallback = F.lit("Unknown Driver") if default is None else default
    return df.join(table, key, "left").withColumn(name, F.coalesce(F.col(name), fallback))


def with_team_names(df: DataFrame, key: str = "Driver") -> DataFrame:
    table = F.broadcast(dims.drivers(df.sparkSession).select(F.col("Driver").alias(key), "team_name"))
    return df.join(table, key, "left").withColumn(
        "team_name", F.coalesce("team_name", F.lit("Unknown Team")))


def with_session_labels(df: DataFrame) -> DataFrame:
    table = F.broadcast(dims.session_labels(df.sparkSession))
    return df.join(table, "Session", "left").withColumn(
        "session_label", F.coalesce("session_label", F.col("Session")))


def with_event_names(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Left lookup of the event name by (Year, Round) in a schedule table."""
    names = schedule.select("Year", F.col("RoundNumber").alias("Round"), "EventName")
    return df.join(names, ["Year", "Round"], "left").withColumn(
        "EventName", F.coalesce("EventName", F.lit("Unknown Race")))


def nearest_in_time(probes: DataFrame, samples: DataFrame, keys: list[str], probe_time: str,
                    sample_time: str, values: list[str], tie: list[str],
                    max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """For every probe the sample of the same key with the smallest absolute time difference.

    Of equally near samples the first by ``tie`` wins. Instead of comparing every probe with every
    sample, both are put on one timeline, which is scanned once, and each probe reads the last
    sample before it and the first one after it.
    """
    asked = probes.withColumn("_probe", F.struct(*probes.columns)).select(
        *keys, F.col(probe_time).alias("_time"), F.lit(1).alias("_kind"), "_probe")
    given = samples.where(F.col(sample_time).isNotNull()).select(
        *keys, F.col(sample_time).alias("_time"), F.lit(0).alias("_kind"), order_key(tie).alias("_rank"),
        F.struct(*values).alias("_row"))
    sizes = samples.select(*keys, F.col(sample_time).alias("_time")).unionByName(
        probes.select(*keys, F.col(probe_time).alias("_time")))
    timeline = Timeline.of(given.unionByName(asked, allowMissingColumns=True), keys, ["_time", "_kind", "_rank"],
                           max_group_rows, sizes)
    # several samples at one instant: only the first by tie can win; a segment holds whole instants
    same = (F.lag("_time").over(timeline.window()) == F.col("_time")) & (F.lag("_kind").over(timeline.window()) == F.col("_kind"))
    timeline = timeline.replace(timeline.rows.withColumn("_again", F.coalesce(same, F.lit(False))))
    sample = F.when((F.col("_kind") == 0) & ~F.col("_again"), F.struct(
        F.col("_time").alias("time"), F.col("_rank").alias("rank"), F.col("_row").alias("row")))
    rows = timeline.around(sample, "_before", "_after", F.col("_probe").isNotNull())
    gap_before = F.abs(F.col("_time") - F.col("_before.time"))
    gap_after = F.abs(F.col("_after.time") - F.col("_time"))
    take_after = F.col("_before").isNull() | (gap_after < gap_before) | (
        (gap_after == gap_before) & (F.col("_after.rank") < F.col("_before.rank")))
    best = F.when(F.col("_after").isNotNull() & take_after, F.col("_after")).otherwise(F.col("_before"))
    found = rows.withColumn("_best", F.when(F.col("_time").isNotNull(), best))
    return found.select(
        "_probe.*", F.col("_best.time").alias("nearest_time"),
        *[F.col(f"_best.row.{v}").alias(v) for v in values])


def position_at(samples: DataFrame, seconds: float, keys: list[str], tie: list[str],
                values: list[str] = ("X", "Y"), time: str = "session_s") -> DataFrame:
    """Values of every key at one scrub time: a plain aggregate, no ordering needed."""
    gap = F.abs(F.col(time) - F.lit(float(seconds)))
    return samples.where(F.col(time).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(time), *values), F.struct(gap, order_key(tie))).alias("_at")
    ).select(*keys, "_at.*")


def pair_metrics(videos: DataFrame, metrics: DataFrame) -> DataFrame:
    """Match processed videos with their metrics file by name."""
    named = videos.withColumn(
        "metrics_name", F.regexp_replace("video_name", r"_HUD\.mp4$", "_metrics.csv"))
    return named.join(metrics, "metrics_name", "left")


def attach_outputs(selections: DataFrame, outputs: DataFrame) -> DataFrame:
    """Session and driver joined with what the anomaly job stored for them, NULL if nothing."""
    return join_summary(selections, outputs, SESSION_KEYS + ["Driver"])


def output_stem(stem: Column, driver: Column) -> Column:
    return F.concat_ws("_", stem, driver, F.lit("mistakes"))


def pending(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work items without an output; ``force`` keeps them all."""
    return work if force else join_summary(work, done.select(*keys).distinct(), keys, "left_anti")
