"""Frame, geometry and apex-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.config import Settings
from lapforge.functions import geometry as G
from lapforge.functions import scalar as S
from lapforge.operators import frames as R
from lapforge.operators import kpi as K
from lapforge.operators import lookup as L
from lapforge.operators.sampling import sample_video_frames, select_frames
from lapforge.queries.registry import query
from lapforge.queries.views import (
    CURBS, CV_METRICS, CV_STATUS, FRAMES, POINTS, VIDEO_FILES, cv_metrics, detections, frames, table,
    video_files,
)
from lapforge.sources.lake import clean_metrics, read_metrics, write_metrics
from lapforge.session import scratch_path

SETTINGS = Settings()


def metrics(spark, sf_dir) -> DataFrame:
    """Metric rows with numeric distance and status."""
    return cv_metrics(spark, sf_dir).withColumn(
        "status", G.apex_status(F.col("distance"), F.col("has_curb")))


def stored_metrics(spark, sf_dir) -> DataFrame:
    """Metric rows as the metrics file holds them."""
    return metrics(spark, sf_dir).withColumn(
        "distance_px", S.distance_text(F.col("distance"), F.col("has_curb")))


@query("o4_select_frames", "WITH " + FRAMES + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY year, video ORDER BY frame_name) - 1 AS pos,
         greatest(1, count(*) OVER (PARTITION BY year, video) // 11) AS step FROM frames)
SELECT year, video, frame_name, concat(year, '_', video, '_', frame_name) AS selected_name
FROM placed WHERE pos % step = 0 AND pos / step < 11""")
def frame_selection(spark, sf_dir):
    return select_frames(frames(spark, sf_dir), SETTINGS.frames_per_video)


@query("o5_w5_sample_video_frames", "WITH " + VIDEO_FILES + """, timed AS (
  SELECT *, CASE WHEN fps > 0 THEN greatest(1, CAST(trunc(fps / 5) AS BIGINT)) ELSE 1 END AS frame_interval FROM video_files)
SELECT video, fps, total_frames, frame_interval, k * frame_interval AS frame_number, k + 1 AS saved_number,
       printf('frame_%05d.jpg', k + 1) AS file_name
FROM (SELECT *, unnest(range((total_frames + frame_interval - 1) // frame_interval)) AS k FROM timed)""")
def video_sampling(spark, sf_dir):
    return sample_video_frames(video_files(spark, sf_dir), SETTINGS.target_fps)


@query("a9_a10_video_summary", "WITH " + CV_STATUS + """
SELECT video, count(*) FILTER (status = 'Hitting Apex') AS hitting, count(*) FILTER (status = 'Near Apex') AS near,
       count(*) FILTER (status = 'Missing Apex') AS missing, count(*) FILTER (has_curb) AS curb_frames,
       round((count(*) FILTER (status = 'Hitting Apex') + count(*) FILTER (status = 'Near Apex'))
             / nullif(count(*) FILTER (has_curb), 0)::DOUBLE * 100, 6) AS apex_accuracy_pct
FROM cv GROUP BY video""")
def video_summary(spark, sf_dir):
    return K.video_summary(metrics(spark, sf_dir)).withColumn(
        "apex_accuracy_pct", F.round("apex_accuracy_pct", 6))


@query("j5_metric_at_scrub_time", "WITH " + CV_STATUS + """
SELECT video, timestamp_sec, status, distance FROM cv
QUALIFY row_number() OVER (PARTITION BY video ORDER BY abs(timestamp_sec - 123.456::DOUBLE), frame_number) = 1""")
def metric_at(spark, sf_dir):
    return L.position_at(metrics(spark, sf_dir), 123.456, ["video"], ["frame_number"],
                         ("status", "distance"), "timestamp_sec")


@query("j5_nearest_metrics", "WITH " + CV_STATUS + """, probes AS (
  SELECT conv_id, turn, concat('video_', conv_id % 10) AS video, (conv_id * 37 + turn * 11) % 400 + 0.013::DOUBLE AS t
  FROM conversations)
SELECT p.conv_id, p.turn, p.t, c.timestamp_sec AS nearest_time, c.status, c.distance
FROM probes p LEFT JOIN cv c USING (video)
QUALIFY row_number() OVER (PARTITION BY p.conv_id, p.turn, p.t ORDER BY abs(c.timestamp_sec - p.t), c.frame_number) = 1""")
def nearest_metrics(spark, sf_dir):
    probes = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "concat('video_', conv_id % 10) as video",
        "(conv_id * 37 + turn * 11) % 400 + 0.013D as t")
    return L.nearest_in_time(probes, metrics(spark, sf_dir), ["video"], "t", "timestamp_sec",
                             ["status", "distance"], ["frame_number"]).drop("video")


@query("j6_pair_metrics", "WITH " + CV_METRICS + """, files AS (
  SELECT concat(video, '_metrics.csv') AS metrics_name, count(*) AS frames FROM cv_metrics WHERE video <> 'video_3' GROUP BY video
), videos AS (SELECT DISTINCT concat('video_', user_id % 10, '_HUD.mp4') AS video_name FROM events)
SELECT v.video_name, regexp_replace(v.video_name, '_HUD\\.mp4$', '_metrics.csv') AS metrics_name, CAST(f.frames AS DOUBLE) AS frames
FROM videos v LEFT JOIN files f ON f.metrics_name = regexp_replace(v.video_name, '_HUD\\.mp4$', '_metrics.csv')""")
def pairs(spark, sf_dir):
    rows = cv_metrics(spark, sf_dir)
    files = rows.where("video <> 'video_3'").groupBy("video").agg(F.count(F.lit(1)).alias("frames")).select(
        F.concat("video", F.lit("_metrics.csv")).alias("metrics_name"), F.col("frames").cast("double").alias("frames"))
    videos = rows.select(F.concat("video", F.lit("_HUD.mp4")).alias("video_name")).distinct()
    return L.pair_metrics(videos, files)


@query("f6_f7_frame_texts", "WITH " + CV_METRICS + """
SELECT video, frame_number, timestamp_sec,
       CASE WHEN has_curb THEN concat(CAST(trunc(distance) AS BIGINT), 'px') ELSE 'N/A' END AS distance_px
FROM cv_metrics""")
def frame_texts(spark, sf_dir):
    return cv_metrics(spark, sf_dir).select(
        "video", "frame_number", S.frame_seconds(F.col("frame_number"), F.lit(30.9)).alias("timestamp_sec"),
        S.distance_text(F.col("distance"), F.col("has_curb")).alias("distance_px"))


@query("s11_s12_metrics_csv", "WITH " + CV_STATUS + """
SELECT video, frame_number, timestamp_sec, CASE WHEN has_curb THEN trunc(distance) END AS distance_px, status, has_curb
FROM cv""")
def metrics_csv(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    write_metrics(stored_metrics(spark, sf_dir), path)
    return read_metrics(spark, path)


@query("f10_f11_clean_metrics", "WITH " + CV_STATUS + """
SELECT video, frame_number, CASE WHEN has_curb THEN trunc(distance) END AS distance_px, has_curb FROM cv""")
def metrics_cleaned(spark, sf_dir):
    texts = stored_metrics(spark, sf_dir).withColumn(
        "has_curb", F.concat(F.lit(" "), F.initcap(F.col("has_curb").cast("string"))))
    return clean_metrics(texts).select("video", "frame_number", "distance_px", "has_curb")


@query("c0_c1_curb_detections", "WITH " + POINTS + """
SELECT video, frame_number, det_idx, confidence FROM detections WHERE confidence >= 0.25 AND class_id = 0""")
def curb_detections(spark, sf_dir):
    return R.confident(detections(spark, sf_dir)).where("class_id = 0").select(
        "video", "frame_number", "det_idx", "confidence")


@query("c2_c3_largest_contour", "WITH " + CURBS + """
SELECT video, frame_number, det_idx, area, cx, turn FROM aimed""")
def largest(spark, sf_dir):
    return R.measure_curbs(R.confident(detections(spark, sf_dir))).select(
        "video", "frame_number", "det_idx", G.contour_area(F.col("contour")).alias("area"), "cx", "turn")


@query("c4_c6_nearest_point", "WITH " + CURBS + """
SELECT video, frame_number, det_idx, turn, CASE WHEN cx IS NOT NULL THEN round(distance, 6) END AS distance,
       CASE WHEN cx IS NOT NULL THEN x END AS x, CASE WHEN cx IS NOT NULL THEN y END AS y FROM hits""")
def nearest_point(spark, sf_dir):
    return R.measure_curbs(R.confident(detections(spark, sf_dir))).select(
        "video", "frame_number", "det_idx", "turn", F.round("hit.distance", 6).alias("distance"),
        F.col("hit.point.x").alias("x"), F.col("hit.point.y").alias("y"))


REDUCED = CURBS + """, reduced AS (
  SELECT video, frame_number, arg_min(distance, struct_pack(d := distance, i := det_idx)) FILTER (cx IS NOT NULL) AS distance,
         arg_min(x, struct_pack(d := distance, i := det_idx)) FILTER (cx IS NOT NULL) AS x,
         arg_max(turn, det_idx) FILTER (cx IS NOT NULL) AS turn_direction
  FROM hits GROUP BY video, frame_number
), all_frames AS (SELECT DISTINCT video, frame_number FROM detections
), frame_rows AS (
  SELECT f.video, f.frame_number, round_even(f.frame_number / 30.0::DOUBLE, 2) AS timestamp_sec, r.video IS NOT NULL AS has_curb,
         coalesce(r.turn_direction, 'Straight') AS turn_direction, r.distance, r.x,
         CASE WHEN r.distance IS NULL THEN 'N/A' ELSE concat(CAST(trunc(r.distance) AS BIGINT), 'px') END AS distance_px,
         CASE WHEN r.distance IS NULL THEN 'Straight' WHEN r.distance < 130 THEN 'Hitting Apex'
              WHEN r.distance < 250 THEN 'Near Apex' ELSE 'Missing Apex' END AS status
  FROM all_frames f LEFT JOIN reduced r USING (video, frame_number))"""


@query("c5_c9_frame_metrics", "WITH " + REDUCED + """
SELECT video, frame_number, timestamp_sec, distance_px, status, has_curb, turn_direction, CAST(x AS DOUBLE) AS closest_x FROM frame_rows""")
def frame_metrics(spark, sf_dir):
    found = detections(spark, sf_dir)
    listing = found.select("video", "frame_number").distinct().withColumn("fps", F.lit(30.0))
    return R.frame_metrics(listing, found).select(
        "video", "frame_number", "timestamp_sec", "distance_px", "status", "has_curb", "turn_direction",
        F.col("closest_point.x").cast("double").alias("closest_x"))


@query("c7_apex_status", "WITH " + CV_STATUS + " SELECT video, frame_number, status FROM cv")
def statuses(spark, sf_dir):
    return metrics(spark, sf_dir).select("video", "frame_number", "status")


@query("c8_wheel_positions", """
SELECT DISTINCT l_partkey AS width, l_suppkey AS height, CAST(trunc(l_partkey * 0.18::DOUBLE) AS INTEGER) AS left_x,
       CAST(trunc(l_partkey * 0.85::DOUBLE) AS INTEGER) AS right_x, CAST(trunc(l_suppkey * 0.60::DOUBLE) AS INTEGER) AS wheel_y
FROM lineitem""")
def wheels(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height")).distinct()
    left, right = G.wheel_positions(F.col("width"), F.col("height"))
    return sizes.withColumns({"_l": left, "_r": right}).select(
        "width", "height", F.col("_l.x").alias("left_x"), F.col("_r.x").alias("right_x"),
        F.col("_l.y").alias("wheel_y"))
