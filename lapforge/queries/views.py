"""Telemetry-shaped views over the given tables, in Spark and in SQL.

Each view is defined twice by the same expressions: as a DataFrame and as a common table expression
for the comparison engine. All of them are plain projections, so filters and column pruning reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["SessionTime", "tie"]
SESSION = ["Year", "Round", "Session"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw telemetry from ``lineitem``: gaps, outliers, six sessions, twenty drivers each."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "case when l_linestatus = 'F' then 2023 else 2024 end as Year",
        "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as Round",
        "case when l_linestatus = 'F' then 'Q' else 'R' end as Session",
        "cast(l_suppkey % 20 as string) as Driver",
        "case when l_partkey % 17 = 0 then null else l_extendedprice / 250 end as Speed",
        "case when l_partkey % 19 = 0 then null else l_quantity * 320 end as RPM",
        "l_discount * 1100 as Throttle",
        "l_tax * 1300 - 2 as Brake",
        "l_linenumber as nGear",
        "case when l_partkey % 17 = 0 then null else l_extendedprice / 100 end as X",
        "case when l_partkey % 19 = 0 then null else l_quantity * 10 end as Y",
        "(l_orderkey * 8 + l_linenumber) * 100000000 as SessionTime",
        "struct(l_partkey, l_suppkey, l_shipdate, l_extendedprice) as tie",
    )


TELEMETRY = """telemetry AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 2023 ELSE 2024 END AS Year,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS Round,
         CASE WHEN l_linestatus = 'F' THEN 'Q' ELSE 'R' END AS Session,
         CAST(l_suppkey % 20 AS VARCHAR) AS Driver,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 250 END AS Speed,
         CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity * 320 END AS RPM,
         l_discount * 1100 AS Throttle,
         l_tax * 1300 - 2 AS Brake,
         l_linenumber AS nGear,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 100 END AS X,
         CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity * 10 END AS Y,
         (l_orderkey * 8 + l_linenumber) * 100000000 AS SessionTime,
         {'p': l_partkey, 's': l_suppkey, 'd': l_shipdate, 'e': l_extendedprice} AS tie
  FROM lineitem)"""

# cleaned the way the cleaning job does: drop, fill over the session in row order, clip, downcast
CLEAN = TELEMETRY + """, filled AS (
  SELECT Year, Round, Session, Driver, SessionTime, tie, Throttle, Brake, nGear,
         last_value(Speed IGNORE NULLS) OVER w AS Speed, last_value(RPM IGNORE NULLS) OVER w AS RPM,
         last_value(X IGNORE NULLS) OVER w AS X, last_value(Y IGNORE NULLS) OVER w AS Y
  FROM telemetry
  WHERE NOT (Speed IS NULL AND RPM IS NULL AND X IS NULL AND Y IS NULL)
  WINDOW w AS (PARTITION BY Year, Round, Session ORDER BY SessionTime, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), clean AS (
  SELECT Year, Round, Session, Driver, SessionTime, tie, nGear,
         CAST(CASE WHEN Speed IS NOT NULL THEN greatest(0.0::DOUBLE, least(380.0::DOUBLE, Speed)) END AS FLOAT) AS Speed,
         CAST(CASE WHEN RPM IS NOT NULL THEN greatest(0.0::DOUBLE, least(15000.0::DOUBLE, RPM)) END AS FLOAT) AS RPM,
         CAST(CASE WHEN Throttle IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, Throttle)) END AS FLOAT) AS Throttle,
         CAST(CASE WHEN Brake IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, Brake)) END AS FLOAT) AS Brake,
         CAST(X AS FLOAT) AS X, CAST(Y AS FLOAT) AS Y
  FROM filled)"""

FEATURES = CLEAN + """, stepped AS (
  SELECT *, Speed - lag(Speed) OVER d AS speed_step, abs(nGear - lag(nGear) OVER d) AS gear_step
  FROM clean WINDOW d AS (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie)
), features AS (
  SELECT *, CAST(Speed::DOUBLE / 380.0::DOUBLE AS FLOAT) AS speed_normalized,
         CAST(Throttle::DOUBLE / 100.0::DOUBLE AS FLOAT) AS throttle_intensity,
         CAST(Brake::DOUBLE / 100.0::DOUBLE AS FLOAT) AS brake_intensity,
         CAST(CASE WHEN coalesce(Brake > 5 AND Throttle > 5, FALSE) THEN 1 ELSE 0 END AS FLOAT) AS brake_throttle_overlap,
         CAST(greatest(-50.0::DOUBLE, least(50.0::DOUBLE, coalesce(speed_step, 0)::DOUBLE)) AS FLOAT) AS speed_delta,
         CAST(least(4.0::DOUBLE, coalesce(gear_step, 0)::DOUBLE) AS FLOAT) AS gear_change,
         CAST(RPM::DOUBLE / 15000.0::DOUBLE AS FLOAT) AS rpm_normalized
  FROM stepped)"""


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap table from ``orders``; every seventh lap time is a whole second, some are missing."""
    return table(spark, sf_dir, "orders").selectExpr(
        "2024 as Year",
        "case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as Round",
        "'R' as Session",
        "cast(o_custkey % 20 as string) as Driver",
        "o_orderkey as LapNumber",
        "o_custkey % 3 as Stint",
        "case o_orderpriority when '1-URGENT' then 'SOFT' when '2-HIGH' then 'MEDIUM' "
        "when '3-MEDIUM' then 'HARD' else 'INTERMEDIATE' end as Compound",
        "case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 "
        "then (60 + o_orderkey % 60) * 1000000000 "
        "else 60000000000 + cast(round(o_totalprice * 100) as bigint) * 1000 end as LapTime",
    )


LAPS = """laps AS (
  SELECT 2024 AS Year, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS Round,
         'R' AS Session, CAST(o_custkey % 20 AS VARCHAR) AS Driver, o_orderkey AS LapNumber,
         o_custkey % 3 AS Stint,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'SOFT' WHEN '2-HIGH' THEN 'MEDIUM'
              WHEN '3-MEDIUM' THEN 'HARD' ELSE 'INTERMEDIATE' END AS Compound,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0
              THEN (60 + o_orderkey % 60) * 1000000000
              ELSE 60000000000 + CAST(round(o_totalprice * 100) AS BIGINT) * 1000 END AS LapTime
  FROM orders)"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event schedule from ``nation``: some rounds have no entry."""
    return table(spark, sf_dir, "nation").selectExpr(
        "2023 + n_regionkey % 2 as Year", "n_nationkey as RoundNumber", "n_name as EventName")


SCHEDULE = """schedule AS (
  SELECT 2023 + n_regionkey % 2 AS Year, n_nationkey AS RoundNumber, n_name AS EventName FROM nation)"""


def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame metrics as stored in the metrics file, from ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('video_', user_id % 10) as video", "cast(event_id as int) as frame_number",
        "bround(event_id / 30D, 2) as timestamp_sec", "value * 5 as distance",
        "event_type <> 'error' as has_curb")


CV_METRICS = """cv_metrics AS (
  SELECT concat('video_', user_id % 10) AS video, CAST(event_id AS INTEGER) AS frame_number,
         round_even(event_id / 30.0::DOUBLE, 2) AS timestamp_sec, value * 5 AS distance,
         event_type <> 'error' AS has_curb
  FROM events)"""

CV_STATUS = CV_METRICS + """, cv AS (
  SELECT *, CASE WHEN NOT has_curb THEN 'Straight' WHEN distance < 130 THEN 'Hitting Apex'
                 WHEN distance < 250 THEN 'Near Apex' ELSE 'Missing Apex' END AS status
  FROM cv_metrics)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted frames from ``documents``: twenty sources as videos."""
    return table(spark, sf_dir, "documents").selectExpr(
        "2023 + cast(substring(source, 4) as int) % 2 as year", "source as video",
        "concat('frame_', lpad(cast(doc_id as string), 9, '0'), '.jpg') as frame_name")


FRAMES = """frames AS (
  SELECT 2023 + CAST(substring(source, 4) AS INTEGER) % 2 AS year, source AS video,
         concat('frame_', lpad(CAST(doc_id AS VARCHAR), 9, '0'), '.jpg') AS frame_name
  FROM documents)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmenter output from ``embeddings``: 64 numbers become two contours of 16 points."""
    point = ("x -> named_struct('x', cast((embedding[2 * x] + 0.6D) * 1600 as int), "
             "'y', cast((embedding[2 * x + 1] + 0.6D) * 900 as int))")
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('video_', vec_id % 7) as video", "cast(vec_id div 21 as int) as frame_number",
        "cast(vec_id div 7 % 3 as int) as det_idx", "label % 3 as class_id",
        "(vec_id * 37 % 100) / 100D as confidence", "1920 as width", "1080 as height",
        f"array(transform(sequence(0, 15), {point}), transform(sequence(16, 31), {point})) as contours")


# one row per contour point; list indexes start at 1 there
POINTS = """detections AS (
  SELECT concat('video_', vec_id % 7) AS video, CAST(vec_id // 21 AS INTEGER) AS frame_number,
         CAST(vec_id // 7 % 3 AS INTEGER) AS det_idx, label % 3 AS class_id,
         (vec_id * 37 % 100) / 100.0::DOUBLE AS confidence, 1920 AS width, 1080 AS height, embedding
  FROM embeddings
), points AS (
  SELECT video, frame_number, det_idx, class_id, confidence, width, height, i // 16 AS contour, i % 16 AS pos,
         CAST(trunc((CAST(embedding[2 * i + 1] AS DOUBLE) + 0.6::DOUBLE) * 1600) AS INTEGER) AS x,
         CAST(trunc((CAST(embedding[2 * i + 2] AS DOUBLE) + 0.6::DOUBLE) * 900) AS INTEGER) AS y
  FROM detections, (SELECT unnest(range(32)) AS i) AS idx
), edges AS (
  SELECT *, coalesce(lag(x) OVER c, last_value(x) OVER a) AS px, coalesce(lag(y) OVER c, last_value(y) OVER a) AS py
  FROM points
  WINDOW c AS (PARTITION BY video, frame_number, det_idx, contour ORDER BY pos),
         a AS (PARTITION BY video, frame_number, det_idx, contour ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), contours AS (
  SELECT video, frame_number, det_idx, contour, any_value(class_id) AS class_id,
         any_value(confidence) AS confidence, any_value(width) AS width, any_value(height) AS height,
         CAST(sum(CAST(px AS BIGINT) * y - CAST(x AS BIGINT) * py) AS DOUBLE) AS area2,
         CAST(sum((CAST(px AS BIGINT) * y - CAST(x AS BIGINT) * py) * (px + x)) AS DOUBLE) AS moment6
  FROM edges GROUP BY video, frame_number, det_idx, contour
), largest AS (
  SELECT * FROM contours
  QUALIFY row_number() OVER (PARTITION BY video, frame_number, det_idx ORDER BY abs(area2) DESC, contour) = 1
)"""

CURBS = POINTS + """, curbs AS (
  SELECT video, frame_number, det_idx, contour, width, height, abs(area2) / 2 AS area,
         CASE WHEN area2 <> 0 THEN CAST(trunc(moment6 / (area2 * 3)) AS INTEGER) END AS cx
  FROM largest WHERE class_id = 0 AND confidence >= 0.25
), aimed AS (
  SELECT *, CASE WHEN cx IS NULL THEN NULL WHEN cx > width // 2 THEN 'Right' ELSE 'Left' END AS turn,
         CASE WHEN cx > width // 2 THEN CAST(trunc(width * 0.85::DOUBLE) AS INTEGER)
              ELSE CAST(trunc(width * 0.18::DOUBLE) AS INTEGER) END AS wx,
         CAST(trunc(height * 0.60::DOUBLE) AS INTEGER) AS wy
  FROM curbs
), measured AS (
  SELECT a.video, a.frame_number, a.det_idx, a.area, a.cx, a.turn, p.x, p.y, p.pos, a.wx,
         sqrt(CAST((p.x - a.wx) * (p.x - a.wx) + (p.y - a.wy) * (p.y - a.wy) AS DOUBLE)) AS distance
  FROM aimed a LEFT JOIN points p ON a.video = p.video AND a.frame_number = p.frame_number
       AND a.det_idx = p.det_idx AND a.contour = p.contour
), hits AS (
  SELECT * FROM measured
  QUALIFY row_number() OVER (PARTITION BY video, frame_number, det_idx ORDER BY distance, pos) = 1
)"""


def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video metadata from ``customer``: frame rates from 0 to 60, lengths from 0 to 199 frames."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_name as video", "c_nationkey * 2.5D as fps",
        "cast(abs(cast(c_acctbal as bigint)) % 200 as bigint) as total_frames")


VIDEO_FILES = """video_files AS (
  SELECT c_name AS video, c_nationkey * 2.5::DOUBLE AS fps,
         CAST(abs(CAST(trunc(c_acctbal) AS BIGINT)) % 200 AS BIGINT) AS total_frames
  FROM customer)"""
