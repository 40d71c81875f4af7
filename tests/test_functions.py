"""Scalar texts, rounding, labels and geometry."""

import math

import pytest
from pyspark.sql import functions as F

from lapforge.config import Settings
from lapforge.functions import geometry as G
from lapforge.functions import scalar as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clock_text_cuts_milliseconds(spark):
    given = [0.0, 59.9999, 61.5, 3661.0005, 86399.999, 7325.25]
    expected = []
    for v in given:
        hours, rest = divmod(v, 3600)
        minutes, secs = divmod(rest, 60)
        expected.append((f"{int(hours):02d}:{int(minutes):02d}:{int(secs):02d}.{int((secs - int(secs)) * 1000):03d}",))
    assert values(spark, [(v,) for v in given], "v double", S.clock_text(F.col("v"))) == expected


def test_lap_text(spark):
    rows = [(89_123_000_000,), (90_000_000_000,), (None,), (89_050_000_000,), (3_723_900_000_000,)]
    assert values(spark, rows, "v long", S.lap_text(F.col("v"))) == [
        ("00:01:29.1",), ("00:01:30",), (None,), ("00:01:29.0",), ("01:02:03.9",)]


def test_one_decimal_is_correctly_rounded(spark):
    given = [23.25, 21.95, 0.05, 0.15, 0.25, 0.35, 300.049999, 0.0, -2.25, 379.95, 99.95, 12.0]
    got = values(spark, [(v,) for v in given], "v double", S.one_decimal(F.col("v")))
    assert got == [(f"{v:.1f}",) for v in given]


def test_round_cents_equals_python(spark):
    given = [0.125, 0.375, 2.675, 1.115, 1.005, 13.375, 0.285, 99.995, 0.0, 100.0] + [m / 997 * 100 for m in range(0, 997, 7)]
    got = values(spark, [(v,) for v in given], "v double", S.round_cents(F.col("v")))
    assert got == [(round(v, 2),) for v in given]


def test_frame_seconds_truncates_rate(spark):
    rows = [(3, 24.9), (9, 24.0), (10, 30.0), (0, 25.0)]
    got = values(spark, rows, "f int, fps double", S.frame_seconds(F.col("f"), F.col("fps")))
    assert got == [(round(f / int(fps), 2),) for f, fps in rows]


def test_distance_and_flag_texts(spark):
    rows = [(123.9, True), (None, True), (5.0, False)]
    assert values(spark, rows, "d double, c boolean", S.distance_text(F.col("d"), F.col("c"))) == [
        ("123px",), ("N/A",), ("N/A",)]
    texts = [("True", "123px"), (" true ", "N/A"), ("False", ""), (None, None), ("1", "a7b8")]
    assert values(spark, texts, "b string, d string", S.parse_flag(F.col("b")), S.parse_distance(F.col("d"))) == [
        (True, 123.0), (True, None), (False, None), (False, None), (False, 7.0)]


def test_labels(spark):
    rows = [("2024_1_Q", "Bahrain", "Qualifying"), ("notes", "x", "y"), ("2024_x_R", "Unknown Race", "Race"),
            ("2024_3_R_extra", "e", "f")]
    label = S.session_option(F.col("s"), F.col("e"), F.col("l"))
    got = values(spark, rows, "s string, e string, l string", label, S.option_round(label),
                 S.header_round(F.col("s")), S.header_session(F.col("s")))
    assert got == [("Round 1: Bahrain - Qualifying", 1, 1, "Q"), ("notes", 999, 1, "Q"),
                   ("Round x: Unknown Race - Race", 999, None, "R"), ("2024_3_R_extra", 999, 3, "R")]


def test_circuit_key(spark):
    assert values(spark, [("São Paulo/Grand Prix",)], "n string", S.circuit_key(F.col("n"))) == [("são_paulo_grand_prix",)]


POINTS = "contour array<struct<x:int,y:int>>"


@pytest.mark.parametrize("ref,contour,distance,point", [
    ((10, 10), [(10, 10)], 0.0, (10, 10)), ((0, 0), [(0, 0), (3, 0), (0, 4)], 0.0, (0, 0)),
    ((0, 0), [(6, 8), (3, 4), (4, 3)], 5.0, (3, 4)), ((0, 0), [], None, None), ((0, 0), None, None, None)])
def test_nearest_point(spark, ref, contour, distance, point):
    df = spark.createDataFrame([(contour,)], POINTS)
    hit = df.select(G.nearest_point(F.struct(F.lit(ref[0]).alias("x"), F.lit(ref[1]).alias("y")), F.col("contour")).alias("h")).first().h
    assert (hit and hit.distance) == distance
    assert (tuple(hit.point) if hit else None) == point


def test_area_centroid_largest(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    far = [(100, 0), (110, 0), (110, 10), (100, 10)]
    line = [(0, 0), (5, 5)]
    df = spark.createDataFrame([([line, square, far],), ([line],), ([],), (None,)],
                               "contours array<array<struct<x:int,y:int>>>")
    rows = df.select(G.largest_contour(F.col("contours")).alias("c")).select(
        "c", G.contour_area(F.col("c")).alias("a"), G.centroid_x(G.moments(F.col("c"))).alias("x")).collect()
    assert [(r.a, r.x) for r in rows] == [(100.0, 5), (0.0, None), (None, None), (None, None)]
    assert [tuple(p) for p in rows[0].c] == square  # the first of equals


@pytest.mark.parametrize("distance,curb,status", [
    (50.0, True, "Hitting Apex"), (130.0, True, "Near Apex"), (150.0, True, "Near Apex"), (250.0, True, "Missing Apex"),
    (300.0, True, "Missing Apex"), (50.0, False, "Straight"), (math.inf, True, "Straight"), (None, True, "Straight")])
def test_status(spark, distance, curb, status):
    assert values(spark, [(distance, curb)], "d double, c boolean", G.apex_status(F.col("d"), F.col("c"))) == [(status,)]


def test_wheels_and_settings(spark):
    left, right = G.wheel_positions(F.lit(1920), F.lit(1080))
    row = spark.range(1).select(left.alias("l"), right.alias("r")).first()
    assert (tuple(row.l), tuple(row.r)) == ((345, 648), (1632, 648))
    s = Settings.from_document({"seasons": ["2025"], "inference": {"hit_threshold": 10}, "unknown": {"a": 1}})
    assert (s.seasons, s.hit_threshold, s.near_threshold) == (("2025",), 10, 250)
