"""Contour geometry on ``array<struct<x,y>>`` columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapforge.config import Settings

DEFAULTS = Settings()

HITTING, NEAR, MISSING, STRAIGHT = "Hitting Apex", "Near Apex", "Missing Apex", "Straight"


def wheel_positions(width: Column, height: Column, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Left and right wheel reference points of a frame."""
    y = (height * F.lit(settings.wheel_y_pct)).cast("int").alias("y")
    left = F.struct((width * F.lit(settings.left_wheel_x_pct)).cast("int").alias("x"), y)
    right = F.struct((width * F.lit(settings.right_wheel_x_pct)).cast("int").alias("x"), y)
    return left, right


def nearest_point(ref: Column, contour: Column) -> Column:
    """struct(distance, index, point) of the first nearest contour point; NULL for no points."""
    def measured(p, i):
        dx = (p["x"] - ref["x"]).cast("double")
        dy = (p["y"] - ref["y"]).cast("double")
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), i.alias("index"), p.alias("point"))

    return F.array_min(F.transform(contour, measured))


def _edges(contour: Column) -> Column:
    """Per edge: cross product of its two ends and that product times the sum of their x."""
    size = F.size(contour)
    before = F.concat(F.slice(contour, size, F.lit(1)), F.slice(contour, F.lit(1), size - 1))

    def edge(p, q):
        cross = (q["x"].cast("double") * p["y"].cast("double")
                 - p["x"].cast("double") * q["y"].cast("double"))
        return F.struct(cross.alias("cross"), (cross * (p["x"] + q["x"]).cast("double")).alias("moment"))

    return F.when(size > 0, F.zip_with(contour, before, edge))


def moments(contour: Column) -> Column:
    """struct(area2, moment6): twice the signed area and six times the first x moment."""
    zero = F.struct(F.lit(0.0).alias("area2"), F.lit(0.0).alias("moment6"))
    return F.aggregate(_edges(contour), zero, lambda acc, e: F.struct(
        (acc["area2"] + e["cross"]).alias("area2"), (acc["moment6"] + e["moment"]).alias("moment6")))


def contour_area(contour: Column) -> Column:
    return F.abs(moments(contour)["area2"]) / 2


def centroid_x(contour_moments: Column) -> Column:
    """Integer part of the polygon's centroid x from its moments; NULL for a contour without area."""
    m = contour_moments
    return F.when(m["area2"] != 0, (m["moment6"] / (m["area2"] * 3)).cast("int"))


def largest_contour(contours: Column) -> Column:
    """Contour with the greatest area, the first of equals; NULL for none."""
    ranked = F.transform(contours, lambda c, i: F.struct(
        F.coalesce(contour_area(c), F.lit(0.0)).alias("area"), (-i).alias("rank"), c.alias("contour")))
    return F.array_max(ranked)["contour"]


def apex_status(distance: Column, has_curb: Column, settings: Settings = DEFAULTS) -> Column:
    """Status of a frame; a missing or infinite distance is a straight."""
    unusable = ~has_curb | distance.isNull() | (distance == F.lit(float("inf")))
    return (F.when(unusable, STRAIGHT)
            .when(distance < settings.hit_threshold, HITTING)
            .when(distance < settings.near_threshold, NEAR)
            .otherwise(MISSING))
