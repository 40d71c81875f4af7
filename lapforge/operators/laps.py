"""Per-lap aggregates and the cost grid of a circuit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.config import MAX_BRAKE, MAX_SPEED
from lapforge.operators.ordered import MAX_GROUP_ROWS, Timeline, join_summary
from lapforge.schema import DRIVER_KEYS, SESSION_KEYS

COMPOUNDS = ("SOFT", "MEDIUM", "HARD")


def lap_features(samples: DataFrame, laps: DataFrame, lap_keys: list[str],
                 max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean channels of every lap, its place in the stint and the tyre compound as flags.

    ``laps`` has one row per ``lap_keys`` with the driver keys, Stint, LapNumber and Compound. A lap without samples
    keeps its place in the stint and has no means.
    """
    means = samples.groupBy(*lap_keys).agg(*[F.avg(c).alias(f"mean_{c.lower()}") for c in ("Speed", "Throttle", "Brake")])
    placed = Timeline.of(laps, DRIVER_KEYS + ["Stint"], ["LapNumber"], max_group_rows, laps).positions(
        "_before", "stint_laps").result()
    return placed.join(means, lap_keys, "left").withColumns({
        "lap_in_stint": F.col("_before") + 1,
        **{f"compound_{c.lower()}": (F.col("Compound") == c).cast("int") for c in COMPOUNDS},
    }).drop("_before")


def cost_grid(telemetry: DataFrame, cell_size: float, keys: list[str] = SESSION_KEYS) -> DataFrame:
    """Track cells with mean speed and brake; cost = brake share + (1 - speed share)."""
    placed = telemetry.where(F.col("X").isNotNull() & F.col("Y").isNotNull())
    return placed.groupBy(
        *keys, F.floor(F.col("X") / cell_size).alias("cell_x"), F.floor(F.col("Y") / cell_size).alias("cell_y")
    ).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("Speed").alias("mean_speed"), F.avg("Brake").alias("mean_brake"),
    ).withColumn("cost", F.col("mean_brake") / MAX_BRAKE + (1 - F.col("mean_speed") / MAX_SPEED))


def grid_edges(grid: DataFrame, keys: list[str] = SESSION_KEYS) -> DataFrame:
    """Edges to the up to eight occupied neighbours, weighted by the cost of the cell entered."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    reach = grid.select(*keys, "cell_x", "cell_y", F.explode(steps).alias("step")).select(
        *keys, F.col("cell_x").alias("from_x"), F.col("cell_y").alias("from_y"),
        (F.col("cell_x") + F.col("step.dx")).alias("cell_x"), (F.col("cell_y") + F.col("step.dy")).alias("cell_y"))
    entered = grid.select(*keys, "cell_x", "cell_y", F.col("cost").alias("weight"))
    return join_summary(reach, entered, [*keys, "cell_x", "cell_y"], "inner").withColumnsRenamed({"cell_x": "to_x", "cell_y": "to_y"})
