"""Lookups, labels, KPIs and dashboard selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge import dims
from lapforge.functions import scalar as S
from lapforge.operators import kpi as K
from lapforge.operators import lookup as L
from lapforge.operators.ordered import Timeline
from lapforge.operators.sampling import sort_rows
from lapforge.plans.dashboard import (
    ai_summary, driver_options, header_bar, mistake_points, score_bars, session_options, telemetry_series, track_map,
)
from lapforge.queries.cleaning import cleaned, featured, featured_timeline
from lapforge.queries.registry import ORACLES, query
from lapforge.queries.views import (
    CLEAN, FEATURES, LAPS, ORDER, SCHEDULE, SESSION, TELEMETRY, laps, schedule, table, telemetry,
)
from lapforge.schema import DRIVER_KEYS, FEATURE_COLUMNS
from lapforge.session import cut_lineage


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DRIVERS = "drivers(Driver, driver_name, team_name) AS (VALUES " + ", ".join(
    f"({sql_text(d)}, {sql_text(n)}, {sql_text(dims.TEAM_NAMES[d])})"
    for d, n in dims.DRIVER_NAMES.items()) + ")"
LABELS = "labels_dim(Session, session_label) AS (VALUES " + ", ".join(
    f"({sql_text(k)}, {sql_text(v)})" for k, v in dims.SESSION_LABELS.items()) + ")"

# stand-in for the anomaly job's output with a rule both engines share
ANNOTATED = FEATURES + """, annotated AS (
  SELECT *, CAST(speed_normalized - 0.2::FLOAT AS FLOAT) AS anomaly_score,
         coalesce(speed_normalized < 0.2::FLOAT OR brake_intensity > 0.9::FLOAT, FALSE) AS is_mistake
  FROM features), counted AS (
  SELECT Year, Round, Session, Driver, count(*) AS total_rows, count(*) FILTER (is_mistake) AS total_mistakes,
         count(*) FILTER (is_mistake AND brake_intensity > 0.5) AS brake_override,
         count(*) FILTER (is_mistake AND throttle_intensity < 0.2 AND speed_delta < -5) AS throttle_slip
  FROM annotated GROUP BY Year, Round, Session, Driver), summary AS (
  SELECT *, round_even(total_mistakes / total_rows::DOUBLE * 100, 2) AS mistake_rate_pct FROM counted)"""
REFERENCES = """, means AS (
  SELECT Year, Round, Session, Driver, CAST(avg(Speed::DOUBLE) AS FLOAT) AS mean_speed FROM clean
  WHERE Driver IS NOT NULL GROUP BY Year, Round, Session, Driver
), refs AS (
  SELECT Year, Round, Session, Driver AS reference_driver, mean_speed FROM means
  QUALIFY row_number() OVER (PARTITION BY Year, Round, Session ORDER BY mean_speed DESC, Driver) = 1)"""


def annotated(spark, sf_dir) -> DataFrame:
    """Rows in the shape the anomaly job stores, flagged by a fixed rule."""
    return annotated_timeline(spark, sf_dir).result()


def annotated_timeline(spark, sf_dir) -> Timeline:
    limit, timeline = F.lit(0.2).cast("float"), featured_timeline(spark, sf_dir)
    return timeline.replace(timeline.rows.withColumns({
        "anomaly_score": (F.col("speed_normalized") - limit).cast("float"),
        "is_mistake": F.coalesce((F.col("speed_normalized") < limit)
                                 | (F.col("brake_intensity") > F.lit(0.9).cast("float")), F.lit(False)),
    }))


def facts(spark, sf_dir) -> DataFrame:
    """One row per driver from one pass over the stand-in output, stored as several steps read it."""
    return cut_lineage(K.driver_facts(annotated(spark, sf_dir)), "facts")


def run_meta(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """Run metadata per driver for the stand-in output."""
    of = facts(spark, sf_dir) if of is None else of
    refs = K.fastest_of(of).drop("mean_speed")
    return of.drop("top_speed", "mean_speed").join(refs, SESSION).withColumns({
        "best_contamination": F.lit(0.12), "best_cv_score": F.lit(0.0625)})


META = ANNOTATED + REFERENCES + """, meta AS (
  SELECT s.*, r.reference_driver, 0.12::DOUBLE AS best_contamination, 0.0625::DOUBLE AS best_cv_score
  FROM summary s JOIN refs r USING (Year, Round, Session))"""


@query("a1_reference_driver", "WITH " + CLEAN + REFERENCES + """
SELECT Year, Round, Session, reference_driver, round(mean_speed::DOUBLE, 2) AS mean_speed FROM refs""")
def reference_driver(spark, sf_dir):
    return K.reference_drivers(cleaned(spark, sf_dir)).withColumn(
        "mean_speed", F.round(F.col("mean_speed").cast("double"), 2))


@query("a2_a6_driver_kpis", "WITH " + CLEAN + """
SELECT Year, Round, Session, Driver, count(*) AS total_rows, coalesce(max(Speed::DOUBLE), 0.0::DOUBLE) AS top_speed,
       min(SessionTime) / 1000000000.0::DOUBLE AS min_t, max(SessionTime) / 1000000000.0::DOUBLE AS max_t,
       round(avg(CASE WHEN coalesce(Brake > 0 AND Throttle > 0, FALSE) THEN 1 ELSE 0 END) * 100, 6) AS brake_overlap_pct,
       round(100 - avg(CASE WHEN coalesce(Brake > 5 AND Throttle > 5, FALSE) THEN 1 ELSE 0 END) * 100, 6) AS perfect_corner_score
FROM clean GROUP BY Year, Round, Session, Driver""")
def driver_kpis(spark, sf_dir):
    return K.driver_kpis(cleaned(spark, sf_dir)).withColumns({
        c: F.round(c, 6) for c in ("brake_overlap_pct", "perfect_corner_score")})


@query("a3_a7_a8_mistake_summary", "WITH " + ANNOTATED + " SELECT * FROM summary")
def mistakes(spark, sf_dir):
    return K.mistake_summary(annotated(spark, sf_dir))


@query("a11_fastest_lap", "WITH " + LAPS + """
SELECT Year, Round, Session, Driver, min(LapTime) AS fastest_lap,
       coalesce(CASE WHEN min(LapTime) IS NOT NULL THEN concat(lpad(CAST(min(LapTime) // 3600000000000 % 24 AS VARCHAR), 2, '0'), ':',
                       lpad(CAST(min(LapTime) // 60000000000 % 60 AS VARCHAR), 2, '0'), ':',
                       lpad(CAST(min(LapTime) // 1000000000 % 60 AS VARCHAR), 2, '0'),
                       CASE WHEN min(LapTime) % 1000000000 = 0 THEN ''
                            ELSE concat('.', CAST(min(LapTime) % 1000000000 // 100000000 AS VARCHAR)) END) END, '—') AS lap_time
FROM laps GROUP BY Year, Round, Session, Driver""")
def fastest_lap(spark, sf_dir):
    return K.fastest_laps(laps(spark, sf_dir))


@query("a12_season_rounds", "WITH " + SCHEDULE + """
SELECT "Year", max(RoundNumber) AS max_round FROM schedule GROUP BY "Year" """)
def season_rounds(spark, sf_dir):
    return K.season_rounds(schedule(spark, sf_dir))


@query("a13_a15_contamination_choice", """
WITH fold_scores AS (
  SELECT l_returnflag AS model, l_linenumber % 5 AS fold, c.v AS contamination, avg(abs(l_discount - c.v)) AS fold_score
  FROM lineitem, (VALUES (0.05::DOUBLE), (0.08), (0.1), (0.12), (0.15), (0.2)) AS c(v)
  GROUP BY l_returnflag, l_linenumber % 5, c.v
), cv AS (SELECT model, contamination, avg(fold_score) AS cv_score FROM fold_scores GROUP BY model, contamination
), best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(cv_score, 10) DESC, contamination) = 1)
SELECT b.model, b.contamination AS best_contamination, round(b.cv_score, 8) AS best_cv_score,
       CAST(c.contamination AS VARCHAR) AS grid_value, round(c.cv_score, 8) AS grid_score
FROM best b JOIN cv c USING (model)""")
def contamination_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 5).alias("fold"), "l_discount",
        F.explode(F.array(*[F.lit(c) for c in (0.05, 0.08, 0.10, 0.12, 0.15, 0.20)])).alias("contamination"))
    scores = rows.groupBy("model", "fold", "contamination").agg(
        F.avg(F.abs(F.col("l_discount") - F.col("contamination"))).alias("fold_score"))
    chosen = K.contamination_scores(scores, ["model"])
    return chosen.select(
        "model", "best_contamination", F.round("best_cv_score", 8).alias("best_cv_score"),
        F.explode("cv_scores").alias("grid_value", "grid_score")).withColumn(
        "grid_score", F.round("grid_score", 8))


@query("m3_exact_percentiles", """
SELECT l_returnflag AS model, c.v AS share, round(quantile_cont(l_extendedprice, c.v), 6) AS quantile
FROM lineitem, (VALUES (0.05::DOUBLE), (0.08), (0.1), (0.12), (0.15), (0.2)) AS c(v)
GROUP BY l_returnflag, c.v""".replace("quantile_cont(l_extendedprice, c.v)", """
       CASE c.v WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.08 THEN quantile_cont(l_extendedprice, 0.08)
                WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.12 THEN quantile_cont(l_extendedprice, 0.12)
                WHEN 0.15 THEN quantile_cont(l_extendedprice, 0.15) ELSE quantile_cont(l_extendedprice, 0.2) END"""))
def percentiles(spark, sf_dir):
    from lapforge.config import CONTAMINATIONS
    from lapforge.operators.quantiles import exact_percentiles
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), "l_extendedprice")
    return exact_percentiles(rows, ["model"], "l_extendedprice", CONTAMINATIONS, 0.0, 110_000.0).withColumn(
        "quantile", F.round("quantile", 6))


@query("a16_header_bar", "WITH " + META + ", " + LAPS + ", " + DRIVERS + """, fastest AS (
  SELECT Year, Round, Session, Driver, min(LapTime) AS lap FROM laps GROUP BY ALL
), top AS (SELECT Year, Round, Session, Driver, max(Speed::DOUBLE) AS top_speed FROM clean GROUP BY ALL)
SELECT t.Year, t.Round, t.Session, t.Driver, printf('%.1f km/h', t.top_speed) AS top_speed,
       coalesce(CASE WHEN lap IS NOT NULL THEN concat(lpad(CAST(lap // 3600000000000 % 24 AS VARCHAR), 2, '0'), ':',
                       lpad(CAST(lap // 60000000000 % 60 AS VARCHAR), 2, '0'), ':',
                       lpad(CAST(lap // 1000000000 % 60 AS VARCHAR), 2, '0'),
                       CASE WHEN lap % 1000000000 = 0 THEN ''
                            ELSE concat('.', CAST(lap % 1000000000 // 100000000 AS VARCHAR)) END) END, '—') AS lap_time,
       coalesce(printf('%.1f%%', m.mistake_rate_pct), '—') AS mistake_rate,
       coalesce(CAST(m.total_mistakes AS VARCHAR), '—') AS mistakes,
       coalesce(r.driver_name, m.reference_driver, '—') AS reference,
       coalesce(CAST(m.best_contamination AS VARCHAR), '—') AS contamination,
       upper(coalesce(d.driver_name, 'Unknown Driver')) AS driver_title,
       coalesce(d.team_name, 'Unknown Team') AS team_name
FROM top t LEFT JOIN fastest f USING (Year, Round, Session, Driver)
LEFT JOIN (SELECT * FROM meta WHERE Driver <> '5') m USING (Year, Round, Session, Driver)
LEFT JOIN drivers d ON d.Driver = t.Driver LEFT JOIN drivers r ON r.Driver = m.reference_driver""")
def header(spark, sf_dir):
    of = facts(spark, sf_dir)
    return header_bar(of, laps(spark, sf_dir), run_meta(spark, sf_dir, of).where("Driver <> '5'"))


@query("j1_j2_driver_dimensions", "WITH " + TELEMETRY + ", " + DRIVERS + """
SELECT t.Year, t.Round, t.Session, t.Driver, coalesce(d.driver_name, 'Unknown Driver') AS driver_name,
       coalesce(d.driver_name, t.Driver) AS name_or_code, coalesce(d.team_name, 'Unknown Team') AS team_name, count(*) AS n
FROM telemetry t LEFT JOIN drivers d USING (Driver) GROUP BY ALL""")
def driver_dimensions(spark, sf_dir):
    counted = telemetry(spark, sf_dir).groupBy(*DRIVER_KEYS).agg(F.count(F.lit(1)).alias("n"))
    named = L.with_driver_names(counted)
    coded = L.with_driver_names(named, F.col("Driver"), name="name_or_code")
    return L.with_team_names(coded).select(*DRIVER_KEYS, "driver_name", "name_or_code", "team_name", "n")


@query("j3_s6_event_names", "WITH " + TELEMETRY + ", " + SCHEDULE + ", " + LABELS + """
SELECT t.Year, t.Round, t.Session, coalesce(s.EventName, 'Unknown Race') AS EventName,
       coalesce(l.session_label, t.Session) AS session_label, count(*) AS n
FROM telemetry t LEFT JOIN schedule s ON s."Year" = t.Year AND s.RoundNumber = t.Round
LEFT JOIN labels_dim l ON l.Session = t.Session GROUP BY ALL""")
def event_names(spark, sf_dir):
    counted = telemetry(spark, sf_dir).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"))
    return L.with_session_labels(L.with_event_names(counted, schedule(spark, sf_dir))).select(
        *SESSION, "EventName", "session_label", "n")


@query("j4_position_at_scrub_time", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, SessionTime / 1000000000.0::DOUBLE AS session_s, X, Y FROM telemetry
QUALIFY row_number() OVER (PARTITION BY Year, Round, Session, Driver
                           ORDER BY abs(SessionTime / 1000000000.0::DOUBLE - 3000), tie) = 1""")
def position_at(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("session_s", K.session_time())
    return L.position_at(rows, 3000.0, DRIVER_KEYS, ["tie"])


@query("j4_nearest_in_time", "WITH " + TELEMETRY + """, probes AS (
  SELECT o_orderkey AS probe, CASE o_orderstatus WHEN 'F' THEN 2023 ELSE 2024 END AS Year, 1 + o_custkey % 3 AS Round,
         CASE o_orderstatus WHEN 'F' THEN 'Q' ELSE 'R' END AS Session, CAST(o_custkey % 20 AS VARCHAR) AS Driver,
         (o_orderkey * 7919 % 130000) * 100000000 + 12345 AS probe_time
  FROM orders)
SELECT p.probe, p.probe_time, t.SessionTime / 1000000000.0::DOUBLE AS nearest_s, t.X, t.Y, t.Speed
FROM probes p LEFT JOIN telemetry t ON p.Year = t.Year AND p.Round = t.Round AND p.Session = t.Session AND p.Driver = t.Driver
QUALIFY row_number() OVER (PARTITION BY p.probe ORDER BY abs(t.SessionTime - p.probe_time), t.tie) = 1""")
def nearest(spark, sf_dir):
    return nearest_positions(spark, sf_dir)


def nearest_positions(spark, sf_dir, **limits) -> DataFrame:
    probes = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as probe", "case o_orderstatus when 'F' then 2023 else 2024 end as Year",
        "cast(1 + o_custkey % 3 as int) as Round", "case o_orderstatus when 'F' then 'Q' else 'R' end as Session",
        "cast(o_custkey % 20 as string) as Driver",
        "(o_orderkey * 7919 % 130000) * 100000000 + 12345 as probe_time")
    return L.nearest_in_time(probes, telemetry(spark, sf_dir), DRIVER_KEYS, "probe_time", "SessionTime",
                             ["X", "Y", "Speed"], ["tie"], **limits).select(
        "probe", "probe_time", S.seconds(F.col("nearest_time")).alias("nearest_s"), "X", "Y", "Speed")


@query("j4_nearest_in_time_segmented", ORACLES["j4_nearest_in_time"])
def nearest_segmented(spark, sf_dir):
    """The layout for drivers too large for one task, forced by a low row limit."""
    return nearest_positions(spark, sf_dir, max_group_rows=400)


@query("j7_attach_outputs", "WITH " + META + """
SELECT t.Year, t.Round, t.Session, t.Driver, t.n, CAST(m.total_mistakes AS DOUBLE) AS total_mistakes, m.mistake_rate_pct,
       concat(t.Year, '_', t.Round, '_', t.Session, '_', t.Driver, '_mistakes') AS output_stem
FROM (SELECT Year, Round, Session, Driver, count(*) AS n FROM telemetry GROUP BY ALL) t
LEFT JOIN (SELECT * FROM meta WHERE Driver <> '5') m USING (Year, Round, Session, Driver)""")
def attach_outputs(spark, sf_dir):
    chosen = telemetry(spark, sf_dir).groupBy(*DRIVER_KEYS).agg(F.count(F.lit(1)).alias("n"))
    stored = run_meta(spark, sf_dir).where("Driver <> '5'").select(
        *DRIVER_KEYS, F.col("total_mistakes").cast("double").alias("total_mistakes"), "mistake_rate_pct")
    stem = F.concat_ws("_", F.col("Year").cast("string"), F.col("Round").cast("string"), "Session")
    return L.attach_outputs(chosen, stored).withColumn("output_stem", L.output_stem(stem, F.col("Driver")))


@query("j8_pending_work", "WITH " + TELEMETRY + ", " + LAPS + """
SELECT DISTINCT t.Year, t.Round, t.Session, t.Driver FROM telemetry t
WHERE NOT EXISTS (SELECT 1 FROM laps l WHERE l.Year = t.Year AND l.Round = t.Round AND l.Session = t.Session
                  AND l.Driver = t.Driver AND l.Stint = 0 AND l.Compound = 'SOFT')""")
def pending_work(spark, sf_dir):
    work = telemetry(spark, sf_dir).select(*DRIVER_KEYS).distinct()
    done = laps(spark, sf_dir).where("Stint = 0 and Compound = 'SOFT'")
    return L.pending(work, done, DRIVER_KEYS)


@query("j9_m1_training_rows", "WITH " + FEATURES + REFERENCES + """, train AS (
  SELECT Year, Round, Session, Driver AS model_driver, 'target' AS role, speed_normalized, brake_intensity FROM features
  UNION ALL
  SELECT f.Year, f.Round, f.Session, d.Driver, 'reference', f.speed_normalized, f.brake_intensity
  FROM features f JOIN refs r ON f.Year = r.Year AND f.Round = r.Round AND f.Session = r.Session AND f.Driver = r.reference_driver
  JOIN (SELECT DISTINCT Year, Round, Session, Driver FROM features) d
       ON d.Year = f.Year AND d.Round = f.Round AND d.Session = f.Session)
SELECT Year, Round, Session, model_driver, role, count(*) AS n, round(sum(speed_normalized::DOUBLE), 4) AS speed_sum,
       round(sum(brake_intensity::DOUBLE), 4) AS brake_sum
FROM train GROUP BY ALL""")
def training_rows(spark, sf_dir):
    from lapforge.operators.iforest import MODEL, training_rows as build
    # read by the own rows, the borrowed rows, the fleet and the reference choice: build it once
    features = cut_lineage(featured(spark, sf_dir).select(*DRIVER_KEYS, *ORDER, "Speed", *FEATURE_COLUMNS), "features")
    return build(features, K.reference_drivers(features), ORDER).groupBy(*MODEL, "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("speed_normalized").cast("double")), 4).alias("speed_sum"),
        F.round(F.sum(F.col("brake_intensity").cast("double")), 4).alias("brake_sum"))


@query("u1_union_parts", "WITH " + TELEMETRY + """
SELECT Year, Round, Session, Driver, CASE WHEN Year = 2024 THEN Speed END AS Speed, RPM FROM telemetry""")
def union_parts(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    with_speed = rows.where("Year = 2024").select(*DRIVER_KEYS, "Speed", "RPM")
    without = rows.where("Year = 2023").select(*DRIVER_KEYS, "RPM")
    return with_speed.unionByName(without, allowMissingColumns=True)


@query("u4_o6_driver_options", "WITH " + TELEMETRY + ", " + DRIVERS + """
SELECT t.Year, t.Round, t.Session, t.Driver, concat(coalesce(d.driver_name, 'Unknown Driver'), ' (#', t.Driver, ')') AS label,
       row_number() OVER (PARTITION BY t.Year, t.Round, t.Session ORDER BY coalesce(d.driver_name, 'Unknown Driver'), t.Driver) AS option_rank
FROM (SELECT DISTINCT Year, Round, Session, Driver FROM telemetry WHERE Driver IS NOT NULL) t LEFT JOIN drivers d USING (Driver)""")
def drivers_sorted(spark, sf_dir):
    return driver_options(telemetry(spark, sf_dir))


STEMS = """stems AS (
  SELECT DISTINCT concat(Year, '_', Round, '_', Session) AS stem FROM telemetry
  UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part
  UNION SELECT DISTINCT concat('2024_', p_size, '_SQ') FROM part)"""


def stems(spark, sf_dir) -> DataFrame:
    sessions = telemetry(spark, sf_dir).select(F.concat_ws(
        "_", F.col("Year").cast("string"), F.col("Round").cast("string"), "Session").alias("stem"))
    part = table(spark, sf_dir, "part")
    return (sessions.union(part.select(F.translate("p_name", " ", "_")))
            .union(part.selectExpr("concat('2024_', p_size, '_SQ')")).distinct())


@query("s3_o2_session_options", "WITH " + TELEMETRY + ", " + SCHEDULE + ", " + LABELS + ", " + STEMS + """, parts AS (
  SELECT stem, string_split(stem, '_') AS p FROM stems
), labelled AS (
  SELECT stem, len(p) AS k, CASE WHEN len(p) = 3 THEN TRY_CAST(p[1] AS INTEGER) END AS Year,
         CASE WHEN len(p) = 3 THEN TRY_CAST(p[2] AS INTEGER) END AS Round, CASE WHEN len(p) = 3 THEN p[3] END AS Session, p
  FROM parts
)
SELECT stem, CASE WHEN k = 3 THEN concat('Round ', p[2], ': ', coalesce(s.EventName, 'Unknown Race'), ' - ',
                                          coalesce(d.session_label, l.Session)) ELSE stem END AS label,
       CASE WHEN k = 3 THEN coalesce(l.Round, 999) ELSE 999 END AS sort_round,
       CASE WHEN k >= 3 THEN TRY_CAST(p[2] AS INTEGER) ELSE 1 END AS header_round,
       CASE WHEN k >= 3 THEN p[3] ELSE 'Q' END AS header_session
FROM labelled l LEFT JOIN schedule s ON s."Year" = l.Year AND s.RoundNumber = l.Round
LEFT JOIN labels_dim d ON d.Session = l.Session""")
def options(spark, sf_dir):
    return session_options(stems(spark, sf_dir), schedule(spark, sf_dir))


@query("o7_sorted_drivers", "WITH " + TELEMETRY + """
SELECT Driver, count(*) AS n FROM telemetry WHERE Driver IS NOT NULL GROUP BY Driver ORDER BY Driver""")
def sorted_drivers(spark, sf_dir):
    return sort_rows(telemetry(spark, sf_dir).dropna(subset=["Driver"]).groupBy("Driver").agg(
        F.count(F.lit(1)).alias("n")), ["Driver"], [])


@query("f1_f8_texts", "WITH " + TELEMETRY + """, clock AS (
  SELECT DISTINCT SessionTime, SessionTime / 1000000000.0::DOUBLE AS s FROM telemetry)
SELECT SessionTime, s AS session_s,
       printf('%02d:%02d:%02d.%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT),
              CAST(floor((s % 3600) % 60) AS BIGINT),
              CAST(floor(((s % 3600) % 60 - floor((s % 3600) % 60)) * 1000) AS BIGINT)) AS clock,
       printf('%.1f', s) AS one_decimal, greatest(100.0::DOUBLE, least(4000.0::DOUBLE, s)) AS clamped,
       concat(lpad(CAST(SessionTime // 3600000000000 % 24 AS VARCHAR), 2, '0'), ':',
              lpad(CAST(SessionTime // 60000000000 % 60 AS VARCHAR), 2, '0'), ':',
              lpad(CAST(SessionTime // 1000000000 % 60 AS VARCHAR), 2, '0'),
              CASE WHEN SessionTime % 1000000000 = 0 THEN ''
                   ELSE concat('.', CAST(SessionTime % 1000000000 // 100000000 AS VARCHAR)) END) AS lap_text
FROM clock""")
def texts(spark, sf_dir):
    s = F.col("session_s")
    return telemetry(spark, sf_dir).select("SessionTime").distinct().withColumn(
        "session_s", S.seconds(F.col("SessionTime"))).select(
        "SessionTime", "session_s", S.clock_text(s).alias("clock"), S.one_decimal(s).alias("one_decimal"),
        S.clamp_value(s, F.lit(100.0), F.lit(4000.0)).alias("clamped"),
        S.lap_text(F.col("SessionTime")).alias("lap_text"))


@query("p20_circuit_keys", """
SELECT DISTINCT p_name AS name, replace(replace(lower(p_name), ' ', '_'), '/', '_') AS file_key FROM part
UNION SELECT DISTINCT o_orderpriority, replace(replace(lower(o_orderpriority), ' ', '_'), '/', '_') FROM orders""")
def circuit_keys(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(
        table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()
    return names.withColumn("file_key", S.circuit_key(F.col("name")))


@query("f10_f11_parse_text", """
SELECT doc_id, coalesce(lower(trim(lang)) = 'fr', FALSE) AS is_fr,
       CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) AS first_number
FROM documents WHERE regexp_extract(text, '([0-9]+)', 1) IS NOT NULL""")
def parse_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.lower(F.trim("lang")) == "fr", F.lit(False)).alias("is_fr"),
        S.parse_distance(F.col("text")).alias("first_number"))


@query("p16_mistake_rows", "WITH " + ANNOTATED + """
SELECT Year, Round, Session, Driver, SessionTime, X::DOUBLE AS X, Y::DOUBLE AS Y, anomaly_score::DOUBLE AS anomaly_score
FROM annotated WHERE is_mistake""")
def mistake_rows(spark, sf_dir):
    return mistake_points(annotated(spark, sf_dir)).select(
        *DRIVER_KEYS, "SessionTime", *[F.col(c).cast("double").alias(c) for c in ("X", "Y", "anomaly_score")])


@query("p19_annotated_schema", "WITH " + ANNOTATED + """
SELECT Year, Round, Session, Driver, SessionTime, Speed::DOUBLE AS Speed, nGear, anomaly_score::DOUBLE AS anomaly_score,
       is_mistake, speed_normalized::DOUBLE AS speed_normalized, throttle_intensity::DOUBLE AS throttle_intensity,
       brake_intensity::DOUBLE AS brake_intensity, brake_throttle_overlap::DOUBLE AS brake_throttle_overlap,
       speed_delta::DOUBLE AS speed_delta, gear_change::DOUBLE AS gear_change, rpm_normalized::DOUBLE AS rpm_normalized
FROM annotated""")
def annotated_rows(spark, sf_dir):
    from lapforge.queries.cleaning import doubles
    return doubles(annotated(spark, sf_dir), ["Speed", "anomaly_score", *FEATURE_COLUMNS]).select(
        *DRIVER_KEYS, "SessionTime", "Speed", "nGear", "anomaly_score", "is_mistake", *FEATURE_COLUMNS)


@query("d1_cross_session_mistakes", "WITH " + ANNOTATED + """
SELECT Round, Session, SessionTime, Speed::DOUBLE AS Speed FROM annotated WHERE Year = 2024 AND Driver = '4' AND is_mistake""")
def cross_session(spark, sf_dir):
    return annotated(spark, sf_dir).where("Year = 2024 and Driver = '4' and is_mistake").select(
        "Round", "Session", "SessionTime", F.col("Speed").cast("double").alias("Speed"))


@query("o3_track_map", "WITH " + ANNOTATED + """, placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY Year, Round, Session, Driver) AS n
  FROM annotated WINDOW w AS (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie))
SELECT Year, Round, Session, Driver, SessionTime, X::DOUBLE AS X, Y::DOUBLE AS Y, anomaly_score::DOUBLE AS color
FROM placed WHERE n <= 200 OR pos % (n // 200) = 0 OR pos = n - 1""")
def map_points(spark, sf_dir):
    points = track_map(annotated_timeline(spark, sf_dir), ORDER, "mistakes", max_points=200)
    return points.select(*DRIVER_KEYS, "SessionTime", *[
        F.col(c).cast("double").alias(c) for c in ("X", "Y", "color")])


@query("f16_score_bars", "WITH " + META + """, bars AS (
  SELECT m.Year, m.Round, m.Session, m.Driver, g.c AS contamination, g.s AS cv_score, m.best_contamination
  FROM meta m, (VALUES (0.05::DOUBLE, 0.01::DOUBLE), (0.12, 0.0625), (0.2, 0.03)) AS g(c, s))
SELECT Year, Round, Session, Driver, contamination, cv_score, abs(contamination - best_contamination) < 1e-6 AS is_best FROM bars""")
def bars(spark, sf_dir):
    scores = F.create_map(*[F.lit(v) for v in ("0.05", 0.01, "0.12", 0.0625, "0.2", 0.03)])
    return score_bars(run_meta(spark, sf_dir).withColumn("cv_scores", scores)).select(
        *DRIVER_KEYS, "contamination", "cv_score", "is_best")


@query("e3_ai_summary", "WITH " + META + ", " + DRIVERS + """
SELECT m.Year, m.Round, m.Session, m.Driver, m.total_mistakes, m.brake_override, m.throttle_slip,
       printf('contamination=%.2f · %d anomalies (%.1f%%) · ref: %s', m.best_contamination, m.total_mistakes,
              m.mistake_rate_pct, coalesce(d.driver_name, m.reference_driver)) AS caption,
       printf('%.4f', m.best_cv_score) AS kfold_score
FROM meta m LEFT JOIN drivers d ON d.Driver = m.reference_driver""")
def ai_panel(spark, sf_dir):
    return ai_summary(None, run_meta(spark, sf_dir)).select(
        *DRIVER_KEYS, "total_mistakes", "brake_override", "throttle_slip", "caption", "kfold_score")


@query("p14_p18_telemetry_series", "WITH " + CLEAN + """, timed AS (
  SELECT *, SessionTime / 1000000000.0::DOUBLE AS session_s FROM clean WHERE Driver IN ('4', '11')
), chosen AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY Year, Round, Session, Driver) AS n
  FROM timed WHERE session_s <= 3000
  WINDOW w AS (PARTITION BY Year, Round, Session, Driver ORDER BY SessionTime, tie)
), thin AS (SELECT * FROM chosen WHERE n <= 100 OR pos % (n // 100) = 0 OR pos = n - 1)
SELECT Year, Round, Session, Driver, CASE WHEN Driver = '4' THEN 'primary' ELSE 'compare' END AS role, session_s, channel, value
FROM (SELECT Year, Round, Session, Driver, session_s, 'Speed' AS channel, Speed::DOUBLE AS value FROM thin
  UNION ALL SELECT Year, Round, Session, Driver, session_s, 'Throttle', Throttle::DOUBLE FROM thin
  UNION ALL SELECT Year, Round, Session, Driver, session_s, 'Brake', Brake::DOUBLE FROM thin
  UNION ALL SELECT Year, Round, Session, Driver, session_s, 'nGear', nGear::DOUBLE FROM thin
  UNION ALL SELECT Year, Round, Session, Driver, session_s, 'RPM', RPM::DOUBLE FROM thin)""")
def scrubbed_series(spark, sf_dir):
    """Chart series of two drivers up to the scrub time, thinned per driver."""
    rows = telemetry_series(cleaned(spark, sf_dir), ["4", "11"], 3000.0, ORDER, max_points=100)
    return rows.select(*DRIVER_KEYS, "role", "session_s", "channel", "value")


@query("f8_thousands", """
SELECT o_orderkey, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS price_text,
       format('{:,}', o_orderkey * 1000003) AS key_text FROM orders""")
def thousands_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.thousands(F.bround("o_totalprice", 0)).alias("price_text"),
        S.thousands(F.col("o_orderkey") * 1000003).alias("key_text"))


@query("s16_config_circuits", "WITH circuits(name, lat, lon) AS (VALUES " + ", ".join(
    f"({sql_text(n)}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in dims.CIRCUITS) + """), places AS (
  SELECT n_nationkey, n_name, CAST(n_nationkey * 7 % 180 - 90 AS DOUBLE) AS lat, CAST(n_nationkey * 13 % 360 - 180 AS DOUBLE) AS lon FROM nation)
SELECT p.n_nationkey, c.name AS circuit, round(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2), 6) AS gap FROM places p, circuits c
QUALIFY row_number() OVER (PARTITION BY p.n_nationkey ORDER BY round(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2), 6), c.name) = 1""")
def circuit_of_nation(spark, sf_dir):
    """The circuit table of a config document, read back from a file: the circuit nearest to a place of each nation."""
    import json
    import tempfile

    from lapforge.config import Settings
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as document:  # read by this process alone
        json.dump({"paths": {}, "data": {"circuits": [dict(zip(("name", "lat", "lon"), c)) for c in dims.CIRCUITS]}}, document)
        document.flush()
        config = Settings.from_file(document.name)
    listed = F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.lit(c["lat"]).alias("lat"), F.lit(c["lon"]).alias("lon"))
                       for c in config.circuits])
    every = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "cast(n_nationkey * 7 % 180 - 90 as double) as at_lat", "cast(n_nationkey * 13 % 360 - 180 as double) as at_lon"
    ).select("*", F.inline(listed))
    gap = F.round(F.pow(F.col("at_lat") - F.col("lat"), 2) + F.pow(F.col("at_lon") - F.col("lon"), 2), 6)
    return every.groupBy("n_nationkey").agg(F.min(F.struct(gap.alias("gap"), "name")).alias("best")).select(
        "n_nationkey", F.col("best.name").alias("circuit"), F.col("best.gap").alias("gap"))
