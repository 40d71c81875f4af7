"""Per-lap features and cost-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.operators.laps import cost_grid, grid_edges, lap_features
from lapforge.queries.cleaning import cleaned
from lapforge.queries.registry import query
from lapforge.queries.views import CLEAN, LAPS, laps, table
from lapforge.schema import DRIVER_KEYS
from lapforge.session import cut_lineage

GRID = CLEAN + """, grid AS (
  SELECT Year, Round, Session, CAST(floor(X / 25.0::DOUBLE) AS BIGINT) AS cell_x, CAST(floor(Y / 25.0::DOUBLE) AS BIGINT) AS cell_y,
         count(*) AS samples, avg(Speed::DOUBLE) AS mean_speed, avg(Brake::DOUBLE) AS mean_brake,
         avg(Brake::DOUBLE) / 100 + (1 - avg(Speed::DOUBLE) / 380) AS cost
  FROM clean WHERE X IS NOT NULL AND Y IS NOT NULL GROUP BY ALL)"""


@query("d3_lap_features", "WITH " + LAPS + """, means AS (
  SELECT l_orderkey AS LapNumber, avg(l_extendedprice / 250) AS mean_speed, avg(l_discount * 1100) AS mean_throttle,
         avg(l_tax * 1300) AS mean_brake FROM lineitem GROUP BY l_orderkey)
SELECT l.Year, l.Round, l.Session, l.Driver, l.LapNumber, l.Stint, round(mean_speed, 6) AS mean_speed,
       round(mean_throttle, 6) AS mean_throttle, round(mean_brake, 6) AS mean_brake,
       row_number() OVER w AS lap_in_stint, CASE WHEN Compound = 'SOFT' THEN 1 ELSE 0 END AS compound_soft,
       CASE WHEN Compound = 'MEDIUM' THEN 1 ELSE 0 END AS compound_medium, CASE WHEN Compound = 'HARD' THEN 1 ELSE 0 END AS compound_hard
FROM laps l LEFT JOIN means USING (LapNumber)
WINDOW w AS (PARTITION BY l.Year, l.Round, l.Session, l.Driver, l.Stint ORDER BY l.LapNumber)""")
def per_lap(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as LapNumber", "l_extendedprice / 250 as Speed", "l_discount * 1100 as Throttle", "l_tax * 1300 as Brake")
    out = lap_features(samples, laps(spark, sf_dir), ["LapNumber"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_speed", "mean_throttle", "mean_brake")}).select(
        *DRIVER_KEYS, "LapNumber", "Stint", "mean_speed", "mean_throttle", "mean_brake", "lap_in_stint",
        "compound_soft", "compound_medium", "compound_hard")


@query("d4_cost_grid", "WITH " + GRID + """
SELECT Year, Round, Session, cell_x, cell_y, samples, round(mean_speed, 4) AS mean_speed, round(mean_brake, 4) AS mean_brake,
       round(cost, 6) AS cost FROM grid""")
def grid(spark, sf_dir):
    return cost_grid(cleaned(spark, sf_dir), 25.0).withColumns({
        "mean_speed": F.round("mean_speed", 4), "mean_brake": F.round("mean_brake", 4), "cost": F.round("cost", 6)})


@query("d4_grid_edges", "WITH " + GRID + """
SELECT a.Year, a.Round, a.Session, a.cell_x AS from_x, a.cell_y AS from_y, b.cell_x AS to_x, b.cell_y AS to_y, round(b.cost, 6) AS weight
FROM grid a JOIN grid b ON a.Year = b.Year AND a.Round = b.Round AND a.Session = b.Session
     AND abs(a.cell_x - b.cell_x) <= 1 AND abs(a.cell_y - b.cell_y) <= 1 AND NOT (a.cell_x = b.cell_x AND a.cell_y = b.cell_y)""")
def edges(spark, sf_dir):
    return grid_edges(cost_grid(cleaned(spark, sf_dir), 25.0)).withColumn("weight", F.round("weight", 6))


# the line of a session: the mean place of its samples in strips of 50 units, four strips a corner
LINE = CLEAN + """, line AS (
  SELECT Year, Round, Session, strip, concat('T', strip // 4 + 1) AS corner, x, y,
         lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM (SELECT Year, Round, Session, CAST(floor(X / 50.0::DOUBLE) AS BIGINT) AS strip, round(avg(X::DOUBLE), 3) AS x, round(avg(Y::DOUBLE), 3) AS y
        FROM clean WHERE X IS NOT NULL AND Y IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY Year, Round, Session ORDER BY strip)
), placed AS (
  SELECT c.Year, c.Round, c.Session, c.Driver, l.corner, l.strip, rid, c.X::DOUBLE AS px, c.Y::DOUBLE AS py, l.x AS ax, l.y AS ay,
         x2 - l.x AS dx, y2 - l.y AS dy
  FROM (SELECT *, row_number() OVER () AS rid FROM clean WHERE X IS NOT NULL AND Y IS NOT NULL) c
  JOIN line l ON c.Year = l.Year AND c.Round = l.Round AND c.Session = l.Session AND l.x2 IS NOT NULL
), near AS (
  SELECT *, round(sqrt(pow(px - (ax + part * dx), 2) + pow(py - (ay + part * dy), 2)), 9) AS distance
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS part FROM placed)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, strip) = 1)"""


@query("d5_line_distance", "WITH " + LINE + """
SELECT Year, Round, Session, Driver, corner, count(*) AS samples, round(avg(distance), 6) AS mean_distance,
       round(max(distance), 6) AS max_distance,
       CASE WHEN avg(distance) <= 60 THEN 'excellent' WHEN avg(distance) <= 90 THEN 'good' WHEN avg(distance) <= 110 THEN 'fair'
            ELSE 'poor' END AS rating
FROM near GROUP BY Year, Round, Session, Driver, corner""")
def line_distance(spark, sf_dir):
    """Every driver's distance to the session's line, by corner."""
    from lapforge.operators.racing_line import line_deviation, line_pieces
    from lapforge.schema import SESSION_KEYS
    # read by the line and by the distances: clean once
    rows = cut_lineage(cleaned(spark, sf_dir).select(*DRIVER_KEYS, "X", "Y"), "cleaned")
    strips = rows.where("X is not null and Y is not null").groupBy(
        *SESSION_KEYS, F.floor(F.col("X") / 50.0).alias("strip")).agg(
        F.round(F.avg(F.col("X").cast("double")), 3).alias("X"), F.round(F.avg(F.col("Y").cast("double")), 3).alias("Y"))
    corner = F.concat(F.lit("T"), (F.floor(F.col("strip") / 4) + 1).cast("string"))
    pieces = line_pieces(strips.withColumn("corner", corner), ["strip"])
    ratings = (("excellent", 60.0), ("good", 90.0), ("fair", 110.0))
    return line_deviation(rows, pieces, ratings=ratings).withColumns({
        "mean_distance": F.round("mean_distance", 6), "max_distance": F.round("max_distance", 6)})
