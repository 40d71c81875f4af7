"""Cleaning, features and driver-series queries on the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators import clean as C
from lapforge.operators.features import engineer_features, feature_timeline
from lapforge.operators.kpi import choose_time, session_time
from lapforge.operators.ordered import Timeline
from lapforge.operators.sampling import downsample
from lapforge.queries.registry import ORACLES, query
from lapforge.queries.views import CLEAN, FEATURES, ORDER, SESSION, TELEMETRY, telemetry
from lapforge.schema import (
    CHART_CHANNELS, CORE_CHANNELS, DRIVER_KEYS, EXPECTED_COLUMNS, FEATURE_COLUMNS, REQUIRED_COLUMNS, repair_columns,
    require_columns,
)
from lapforge.session import cut_lineage

GAPPY = ["Speed", "RPM", "X", "Y"]


def cleaned(spark, sf_dir) -> DataFrame:
    return C.clean(telemetry(spark, sf_dir), SESSION, ORDER, columns=GAPPY)


def cleaned_timeline(spark, sf_dir) -> Timeline:
    return C.clean_timeline(telemetry(spark, sf_dir), SESSION, ORDER, columns=GAPPY)


def featured_timeline(spark, sf_dir) -> Timeline:
    return feature_timeline(cleaned_timeline(spark, sf_dir), order=ORDER)


def featured(spark, sf_dir) -> DataFrame:
    return featured_timeline(spark, sf_dir).result()


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("p1_keep_existing_columns", "WITH " + TELEMETRY + """
SELECT SessionTime, Speed, RPM, nGear, Throttle, Brake, X, Y, Driver, Round, Session, Year FROM telemetry""")
def keep_columns(spark, sf_dir):
    from lapforge.schema import keep_existing
    return keep_existing(telemetry(spark, sf_dir))


@query("p2_repair_columns", """
SELECT l_partkey AS row_index, l_quantity AS Speed, 'UNKNOWN' AS Driver, 0.0::DOUBLE AS RPM, 0.0::DOUBLE AS Throttle,
       0.0::DOUBLE AS Brake, 0.0::DOUBLE AS X, 0.0::DOUBLE AS Y, l_partkey * 1000000000 AS "Time",
       l_partkey * 1000000000 AS SessionTime, 8 AS nGear
FROM lineitem""")
def repaired(spark, sf_dir):
    from lapforge.queries.views import table
    raw = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as row_index", "l_quantity as Speed")
    return repair_columns(raw).select("row_index", *EXPECTED_COLUMNS)


@query("p3_drop_dead_packets", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime, Speed, RPM, X, Y FROM telemetry
WHERE Speed IS NOT NULL OR RPM IS NOT NULL OR X IS NOT NULL OR Y IS NOT NULL""")
def dead_packets(spark, sf_dir):
    return C.drop_dead_packets(telemetry(spark, sf_dir)).select(*DRIVER_KEYS, "SessionTime", *CORE_CHANNELS)


@query("p4_forward_fill", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime, last_value(Speed IGNORE NULLS) OVER w AS Speed,
       last_value(RPM IGNORE NULLS) OVER w AS RPM, last_value(X IGNORE NULLS) OVER w AS X,
       last_value(Y IGNORE NULLS) OVER w AS Y
FROM telemetry
WINDOW w AS (PARTITION BY Year, Round, Session ORDER BY SessionTime, tie
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_file(spark, sf_dir):
    return C.forward_fill(telemetry(spark, sf_dir), SESSION, ORDER, columns=GAPPY).select(
        *DRIVER_KEYS, "SessionTime", *CORE_CHANNELS)


@query("p4_forward_fill_segmented", ORACLES["p4_forward_fill"])
def fill_file_segmented(spark, sf_dir):
    """The layout for sessions too large for one task, forced by a low row limit."""
    return C.forward_fill(telemetry(spark, sf_dir), SESSION, ORDER, columns=GAPPY, max_group_rows=4000).select(
        *DRIVER_KEYS, "SessionTime", *CORE_CHANNELS)


@query("p4_forward_fill_per_driver", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime, last_value(Speed IGNORE NULLS) OVER w AS Speed,
       last_value(RPM IGNORE NULLS) OVER w AS RPM, last_value(X IGNORE NULLS) OVER w AS X,
       last_value(Y IGNORE NULLS) OVER w AS Y
FROM telemetry
WINDOW w AS (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_driver(spark, sf_dir):
    return C.forward_fill(telemetry(spark, sf_dir), SESSION, ORDER, "driver", GAPPY).select(
        *DRIVER_KEYS, "SessionTime", *CORE_CHANNELS)


@query("p5_clip_outliers", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime,
       CASE WHEN Speed IS NOT NULL THEN greatest(0.0::DOUBLE, least(380.0::DOUBLE, Speed)) END AS Speed,
       CASE WHEN RPM IS NOT NULL THEN greatest(0.0::DOUBLE, least(15000.0::DOUBLE, RPM)) END AS RPM,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, Throttle)) AS Throttle,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, Brake)) AS Brake
FROM telemetry""")
def clipped(spark, sf_dir):
    return C.clip_outliers(telemetry(spark, sf_dir)).select(
        *DRIVER_KEYS, "SessionTime", "Speed", "RPM", "Throttle", "Brake")


@query("p6_clean_telemetry", "WITH " + CLEAN + """
SELECT Year, Round, Session, Driver, SessionTime, nGear, Speed::DOUBLE AS Speed, RPM::DOUBLE AS RPM,
       Throttle::DOUBLE AS Throttle, Brake::DOUBLE AS Brake, X::DOUBLE AS X, Y::DOUBLE AS Y FROM clean""")
def clean_rows(spark, sf_dir):
    return doubles(cleaned(spark, sf_dir).drop("tie"), C.FLOAT_CHANNELS)


@query("p7_sessions_with_rows", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, count(*) AS raw_rows FROM telemetry GROUP BY ALL HAVING count(*) > 0""")
def nonempty_sessions(spark, sf_dir):
    return C.dropped_rows(telemetry(spark, sf_dir), SESSION).where("raw_rows > 0").select(*SESSION, "raw_rows")


@query("p8_dropped_rows", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, count(*) AS raw_rows,
       count(*) FILTER (Speed IS NULL AND RPM IS NULL AND X IS NULL AND Y IS NULL) AS rows_dropped,
       count(*) FILTER (NOT (Speed IS NULL AND RPM IS NULL AND X IS NULL AND Y IS NULL)) AS row_count
FROM telemetry GROUP BY Year, Round, Session""")
def dropped(spark, sf_dir):
    return C.dropped_rows(telemetry(spark, sf_dir), SESSION)


@query("p9_p10_driver_slice", "WITH " + CLEAN + """
SELECT Year, Round, Session, Driver, Speed::DOUBLE AS Speed, RPM::DOUBLE AS RPM, Throttle::DOUBLE AS Throttle,
       Brake::DOUBLE AS Brake, X::DOUBLE AS X, Y::DOUBLE AS Y, SessionTime, nGear FROM clean WHERE Driver = '1'""")
def driver_slice(spark, sf_dir):
    rows = require_columns(cleaned(spark, sf_dir)).where("Driver = '1'")
    return doubles(rows.select(*SESSION, *REQUIRED_COLUMNS), C.FLOAT_CHANNELS)


@query("p11_p13_features", "WITH " + FEATURES + """
SELECT Year, Round, Session, Driver, SessionTime, speed_normalized::DOUBLE AS speed_normalized,
       throttle_intensity::DOUBLE AS throttle_intensity, brake_intensity::DOUBLE AS brake_intensity,
       brake_throttle_overlap::DOUBLE AS brake_throttle_overlap, speed_delta::DOUBLE AS speed_delta,
       gear_change::DOUBLE AS gear_change, rpm_normalized::DOUBLE AS rpm_normalized FROM features""")
def features(spark, sf_dir):
    return doubles(featured(spark, sf_dir), FEATURE_COLUMNS).select(
        *DRIVER_KEYS, "SessionTime", *FEATURE_COLUMNS)


@query("p11_p13_features_segmented", ORACLES["p11_p13_features"])
def features_segmented(spark, sf_dir):
    # read by the counts of the layout, by its summary and by the rows: clean once
    stored = cut_lineage(cleaned(spark, sf_dir), "cleaned")
    cut = engineer_features(stored, order=ORDER, max_group_rows=400)
    return doubles(cut, FEATURE_COLUMNS).select(*DRIVER_KEYS, "SessionTime", *FEATURE_COLUMNS)


@query("w1_step_sums", "WITH " + FEATURES + """
SELECT Year, Round, Session, Driver, count(*) AS n, CAST(sum(gear_change) AS BIGINT) AS gear_steps,
       round(sum(speed_delta::DOUBLE), 3) AS speed_steps
FROM features GROUP BY Year, Round, Session, Driver""")
def step_sums(spark, sf_dir):
    return featured(spark, sf_dir).groupBy(*DRIVER_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gear_change").cast("bigint").alias("gear_steps"),
        F.round(F.sum(F.col("speed_delta").cast("double")), 3).alias("speed_steps"))


@query("p14_scrub_filter", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime / 1000000000.0::DOUBLE AS session_s, Speed
FROM telemetry WHERE SessionTime / 1000000000.0::DOUBLE <= 5000""")
def scrubbed(spark, sf_dir):
    # on the stored integer, so that the scan can skip row groups
    return telemetry(spark, sf_dir).where(F.col("SessionTime") <= 5000 * 1_000_000_000).select(
        *DRIVER_KEYS, session_time().alias("session_s"), "Speed")


@query("p15_choose_time_column", "WITH " + TELEMETRY + """, clocks AS (
  SELECT *, CASE WHEN Driver IN ('3', '7') THEN NULL ELSE SessionTime END AS clock, CAST(nGear AS BIGINT) * 1000000000 AS lap_clock
  FROM telemetry)
SELECT Year, Round, Session, Driver, SessionTime,
       CASE WHEN count(clock) OVER (PARTITION BY Year, Round, Session, Driver) > 0
            THEN clock / 1000000000.0::DOUBLE ELSE lap_clock / 1000000000.0::DOUBLE END AS session_s
FROM clocks""")
def chosen_time(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumns({
        "_original": F.col("SessionTime"),
        "SessionTime": F.when(~F.col("Driver").isin("3", "7"), F.col("SessionTime")),
        "Time": F.col("nGear") * F.lit(1_000_000_000).cast("bigint")})
    return choose_time(rows).select(*DRIVER_KEYS, F.col("_original").alias("SessionTime"), "session_s")


@query("p17_compare_drivers", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, CASE WHEN Driver = '1' THEN 'primary' ELSE 'compare' END AS role, SessionTime, Speed
FROM telemetry WHERE Driver IN ('1', '11')""")
def compared(spark, sf_dir):
    return telemetry(spark, sf_dir).where(F.col("Driver").isin("1", "11")).select(
        *DRIVER_KEYS, F.when(F.col("Driver") == "1", "primary").otherwise("compare").alias("role"),
        "SessionTime", "Speed")


def chart_series(df: DataFrame, keys: list[str] = DRIVER_KEYS) -> DataFrame:
    """Five channels against time, one row per channel and sample."""
    return df.withColumns({c: F.col(c).cast("double") for c in CHART_CHANNELS}).unpivot(
        keys + ["session_s"], CHART_CHANNELS, "channel", "value")


@query("p18_chart_series", "WITH " + TELEMETRY + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie) - 1 AS pos,
         count(*) OVER (PARTITION BY Year, Round, Session, Driver) AS n
  FROM telemetry WHERE Driver IN ('1', '11')
), thin AS (SELECT * FROM placed WHERE n <= 100 OR pos % (n // 100) = 0 OR pos = n - 1
), wide AS (
  SELECT Year, Round, Session, Driver, SessionTime / 1000000000.0::DOUBLE AS session_s, c.channel,
         CASE c.channel WHEN 'Speed' THEN Speed WHEN 'Throttle' THEN Throttle WHEN 'Brake' THEN Brake
              WHEN 'nGear' THEN nGear::DOUBLE ELSE RPM END AS value
  FROM thin, (VALUES ('Speed'), ('Throttle'), ('Brake'), ('nGear'), ('RPM')) AS c(channel))
SELECT * FROM wide""")
def series(spark, sf_dir):
    pair = telemetry(spark, sf_dir).where(F.col("Driver").isin("1", "11"))
    thin = downsample(pair, DRIVER_KEYS, ORDER, 100).withColumn("session_s", session_time())
    return chart_series(thin)


@query("o1_driver_order", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime, Speed,
       row_number() OVER (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie) - 1 AS position
FROM telemetry""")
def ordered(spark, sf_dir):
    from lapforge.operators.ordered import Timeline
    return Timeline.of(telemetry(spark, sf_dir), DRIVER_KEYS, ORDER).positions().result().select(
        *DRIVER_KEYS, "SessionTime", "Speed", "position")


@query("o3_downsample", "WITH " + TELEMETRY + """, placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY Year, Round, Session) AS n
  FROM telemetry WINDOW w AS (PARTITION BY Year, Round, Session ORDER BY SessionTime, tie))
SELECT Year, Round, Session, Driver, SessionTime, Speed, X, Y FROM placed
WHERE n <= 500 OR pos % (n // 500) = 0 OR pos = n - 1""")
def downsampled(spark, sf_dir):
    return downsample(telemetry(spark, sf_dir), SESSION, ORDER, 500).select(
        *DRIVER_KEYS, "SessionTime", "Speed", "X", "Y")


@query("o3_downsample_segmented", ORACLES["o3_downsample"])
def downsampled_segmented(spark, sf_dir):
    return downsample(telemetry(spark, sf_dir), SESSION, ORDER, 500, max_group_rows=4000).select(
        *DRIVER_KEYS, "SessionTime", "Speed", "X", "Y")


@query("o3_downsample_strict", "WITH " + TELEMETRY + """, placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY Year, Round, Session) AS n
  FROM telemetry WINDOW w AS (PARTITION BY Year, Round, Session ORDER BY SessionTime, tie))
SELECT Year, Round, Session, Driver, SessionTime, Speed FROM placed
WHERE n <= 800 OR pos % CAST(ceil(n / 800.0::DOUBLE) AS BIGINT) = 0 OR pos = n - 1""")
def downsampled_strict(spark, sf_dir):
    return downsample(telemetry(spark, sf_dir), SESSION, ORDER, 800, strict=True).select(
        *DRIVER_KEYS, "SessionTime", "Speed")


@query("w3_w4_positions", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, SessionTime, Driver,
       row_number() OVER (PARTITION BY Year, Round, Session ORDER BY SessionTime, tie) - 1 AS position,
       count(*) OVER (PARTITION BY Year, Round, Session) AS group_rows
FROM telemetry""")
def positions(spark, sf_dir):
    from lapforge.operators.ordered import Timeline
    return Timeline.of(telemetry(spark, sf_dir), SESSION, ORDER).positions().result().select(
        *SESSION, "SessionTime", "Driver", "position", "group_rows")
