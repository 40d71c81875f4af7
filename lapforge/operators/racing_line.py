"""Distance of every sample to a given line, by corner, with a rating.

Samples are put into the cells of a grid. For each cell that holds samples the pieces are listed that can be nearest
to any of them: those that are hardly farther from the middle of the samples than the nearest one. So a sample meets
few pieces, in one join. The lists are found on coarser grids, whose cells list the pieces in and around them; a cell
whose pieces may lie farther away is asked again on a grid of four times the cell size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators.ordered import join_summary
from lapforge.schema import DRIVER_KEYS, SESSION_KEYS
from lapforge.session import cut_lineage

CELL_SIZE, WIDER = 25.0, 4
RATINGS = (("excellent", 0.5), ("good", 1.0), ("fair", 2.0))  # largest mean distance of each, beyond it "poor"


def line_pieces(points: DataFrame, order: list[str], keys: list[str] = SESSION_KEYS) -> DataFrame:
    """(keys, piece, corner, ax, ay, bx, by): the stretches between consecutive points (X, Y, corner) of every line.

    A stretch belongs to the corner of its first point. Points without finite coordinates are left out; a single point
    is a stretch of no length. ``keys`` with many points are ordered in one task each, as a line is short.
    """
    whole = points.where(finite("X") & finite("Y"))
    w = Window.partitionBy(*keys).orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ends = whole.select(
        *keys, (F.row_number().over(w) - 1).alias("piece"), "corner", F.col("X").cast("double").alias("ax"),
        F.col("Y").cast("double").alias("ay"), F.lead(F.col("X").cast("double")).over(w).alias("bx"),
        F.lead(F.col("Y").cast("double")).over(w).alias("by"), size.alias("_size"))
    return ends.where("bx is not null or _size = 1").withColumns(
        {"bx": F.coalesce("bx", "ax"), "by": F.coalesce("by", "ay")}).drop("_size")


def finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def piece_shape() -> Column:
    """A stretch as one struct, with what its distances share."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.struct("piece", "corner", "ax", "ay", dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("length"))


def piece_distances(x: Column, y: Column, pieces: Column) -> Column:
    """(distance, shape) of a point to every stretch of a list.

    In two steps, as expressions inside a list are computed as often as they are named.
    """
    def offset(p: Column) -> Column:
        along = ((x - p["ax"]) * p["dx"] + (y - p["ay"]) * p["dy"]) / p["length"]
        part = F.when(p["length"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(F.lit(0.0))
        return F.struct((x - (p["ax"] + part * p["dx"])).alias("x"), (y - (p["ay"] + part * p["dy"])).alias("y"), p.alias("shape"))

    return F.transform(F.transform(pieces, offset), lambda o: F.struct(
        F.sqrt(o["x"] * o["x"] + o["y"] * o["y"]).alias("distance"), o["shape"].alias("shape")))


def _cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells of an interval and of its neighbours."""
    place = lambda v: F.floor(v / F.lit(size))
    return F.explode(F.sequence(place(low) - 1, place(high) + 1))


def cell_lists(cells: DataFrame, pieces: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, _cx, _cy, _near): the stretches that can be nearest to any point of a cell.

    ``cells`` has the bounds of each cell's points. The points lie within half the diagonal of the bounds from their
    middle, so a stretch that is farther from the middle than the nearest one by more than the diagonal is never nearest.
    """
    middle = lambda low, high: F.col(low) / 2 + F.col(high) / 2
    wide, high = F.col("_high_x") - F.col("_low_x"), F.col("_high_y") - F.col("_low_y")
    x, y, done = F.col("_x"), F.col("_y"), None
    open_cells = cells.select(*keys, "_cx", "_cy", middle("_low_x", "_high_x").alias("_x"), middle("_low_y", "_high_y").alias("_y"),
                              F.sqrt(wide * wide + high * high).alias("_diagonal"))
    while True:
        spread = pieces.withColumn("_px", _cells(F.least("ax", "bx"), F.greatest("ax", "bx"), size)).withColumn(
            "_py", _cells(F.least("ay", "by"), F.greatest("ay", "by"), size))
        lists = spread.groupBy(*keys, "_px", "_py").agg(F.collect_list(piece_shape()).alias("_around"))
        placed = open_cells.withColumns({"_px": F.floor(x / size), "_py": F.floor(y / size)})
        # what is not in the list is at least so far away
        reach = F.least(x - (F.col("_px") - 1) * size, (F.col("_px") + 2) * size - x,
                        y - (F.col("_py") - 1) * size, (F.col("_py") + 2) * size - y)
        asked = join_summary(placed, lists, [*keys, "_px", "_py"]).withColumns(
            {"_far": piece_distances(x, y, F.col("_around")), "_reach": reach})
        least = F.array_min(F.transform("_far", lambda p: p["distance"]))
        # distances are rounded to 10^-9 and are exact to some digits less than a double has
        slack = F.col("_diagonal") + 1e-8 + (F.abs(x) + F.abs(y) + F.col("_diagonal") + F.col("_least")) * 1e-12
        asked = asked.withColumn("_least", least).withColumn("_most", F.col("_least") + slack)
        asked = cut_lineage(asked.withColumn("_found", F.coalesce(F.col("_most") <= F.col("_reach"), F.lit(False))).withColumn(
            "_near", F.when(F.col("_found"), F.transform(F.filter("_far", lambda p: p["distance"] <= F.col("_most")), lambda p: p["shape"])))
            .select(*open_cells.columns, "_found", "_near"), "asked")
        found = asked.where("_found").select(*keys, "_cx", "_cy", "_near")
        done = found if done is None else done.unionByName(found)
        open_cells, size = asked.where("not _found").select(*open_cells.columns), size * WIDER
        if open_cells.isEmpty():
            return done


def nearest_piece(samples: DataFrame, pieces: DataFrame, keys: list[str] = SESSION_KEYS, cell_size: float = CELL_SIZE
                  ) -> DataFrame:
    """``samples`` (keys, X, Y) with ``line_distance``, ``piece`` and ``corner`` of the nearest stretch of their line.

    Of equally near stretches (to 10^-9) the first counts. Samples without finite coordinates, or whose key has no line,
    get NULLs. The list of a cell holds the stretches around it, at most those of one line.
    """
    pieces, size = cut_lineage(pieces, "pieces"), float(cell_size)
    x, y = F.col("X").cast("double"), F.col("Y").cast("double")
    place = lambda v: F.when(finite("X") & finite("Y"), F.floor(v / size))
    placed = cut_lineage(samples.withColumns({"_cx": place(x), "_cy": place(y)}), "samples")
    cells = placed.where("_cx is not null").groupBy(*keys, "_cx", "_cy").agg(
        F.min(x).alias("_low_x"), F.max(x).alias("_high_x"), F.min(y).alias("_low_y"), F.max(y).alias("_high_y"))
    with_line = join_summary(cells, pieces.select(*keys).distinct(), keys, "left_semi")
    lists = cell_lists(with_line, pieces, keys, size * WIDER)
    best = F.array_min(F.transform(piece_distances(x, y, F.col("_near")), lambda p: F.struct(
        F.round(p["distance"], 9).alias("line_distance"), p["shape"]["piece"].alias("piece"), p["shape"]["corner"].alias("corner"))))
    return join_summary(placed, lists, [*keys, "_cx", "_cy"]).withColumn("_best", best).select(*samples.columns, "_best.*")


def line_deviation(samples: DataFrame, pieces: DataFrame, keys: list[str] = SESSION_KEYS, by: list[str] = DRIVER_KEYS,
                   ratings: tuple[tuple[str, float], ...] = RATINGS, cell_size: float = CELL_SIZE) -> DataFrame:
    """Per ``by`` and corner: samples, mean and largest distance to the line, and the rating of the mean."""
    # a filter on the corner would be pushed below the search and compute it twice
    rows = nearest_piece(samples, pieces, keys, cell_size).groupBy(*by, "corner").agg(
        F.count("corner").alias("samples"), F.avg("line_distance").alias("mean_distance"),
        F.max("line_distance").alias("max_distance")).where("samples > 0")
    rating = F.lit("poor")
    for name, most in reversed(ratings):
        rating = F.when(F.round("mean_distance", 9) <= most, F.lit(name)).otherwise(rating)
    return rows.withColumn("rating", rating)
