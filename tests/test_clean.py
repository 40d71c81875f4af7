"""Cleaning: dropping, filling, clipping, repair and types."""

import math

import pytest
from pyspark.sql import functions as F

from lapforge.operators import clean as C
from lapforge.schema import MissingColumnsError, conform, keep_existing, repair_columns, require_columns

SCHEMA = ("row_index long, part_file string, session_file string, Driver string, Speed double, RPM double, "
          "Throttle double, Brake double, X double, Y double, nGear int, SessionTime long, Time long")
ORDER = ["part_file", "row_index"]


def dirty(spark):
    rows = []
    for i in range(100):
        speed = 500.0 if 80 <= i < 85 else None if i >= 90 else 200.0
        rpm = 20000.0 if 85 <= i < 90 else None if i >= 90 else 8000.0
        throttle = 150.0 if 80 <= i < 85 else None if i >= 95 else 50.0
        brake = -10.0 if 80 <= i < 83 else None if i >= 95 else 0.0
        xy = (None, None) if i >= 90 else (100.0, 200.0)
        rows.append((i, "f", "2024_1_Q", "1", speed, rpm, throttle, brake, *xy, 5, i * 10**9, i * 10**9))
    return spark.createDataFrame(rows, SCHEMA)


def test_dirty_session(spark):
    out = C.clean(dirty(spark), ["session_file"], ORDER)
    stats = out.agg(F.count("*").alias("n"), F.min("Speed").alias("s0"), F.max("Speed").alias("s1"),
                    F.max("RPM").alias("r"), F.max("Throttle").alias("t"), F.min("Brake").alias("b")).first()
    assert stats.n == 90
    assert (stats.s0, stats.s1) == (200.0, 380.0)
    assert stats.r <= 15000 and stats.t <= 100 and stats.b >= 0
    for c in C.FLOAT_CHANNELS:
        assert out.schema[c].dataType.simpleString() == "float"


def test_partial_gap_is_filled(spark):
    rows = [(i, "f", "s", "1", None if 20 <= i < 25 else float(i), 1.0, 1.0, 1.0, 1.0, 1.0, 5, i, i) for i in range(50)]
    out = C.clean(spark.createDataFrame(rows, SCHEMA), ["session_file"], ORDER)
    assert out.count() == 50
    assert out.where("Speed is null").count() == 0
    assert {r.Speed for r in out.where("row_index between 20 and 24").collect()} == {19.0}


def leak(spark):
    rows = [(0, "f", "s", "1", 100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5, 0, 0),
            (1, "f", "s", "2", None, 1.0, 1.0, 1.0, 1.0, 1.0, 5, 1, 1),
            (2, "f", "s", "2", 50.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5, 2, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("scope,expected", [("file", 100.0), ("driver", None)])
def test_fill_scope(spark, scope, expected):
    out = C.forward_fill(leak(spark), ["session_file"], ORDER, scope)
    assert out.where("row_index = 1").first().Speed == expected


def test_unknown_scope(spark):
    with pytest.raises(ValueError):
        C.forward_fill(leak(spark), ["session_file"], ORDER, "lap")


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (400.0,)], "Speed double")
    assert [r.Speed for r in C.clip_outliers(df).collect()] == [None, 0.0, 380.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(math.nan, "x"), (1.0, "y")], "Speed double, __index_level_0__ string")
    out = conform(df)
    assert out.columns == ["Speed"]
    assert [r.Speed for r in out.collect()] == [None, 1.0]


@pytest.mark.parametrize("column,expected", [("Driver", "UNKNOWN"), ("nGear", 8), ("Time", 3 * 10**9), ("RPM", 0.0)])
def test_repair(spark, column, expected):
    out = repair_columns(dirty(spark).drop(column))
    assert out.where("row_index = 3").first()[column] == expected


def test_read_repair_leaves_channels_absent(spark):
    out = repair_columns(dirty(spark).drop("RPM", "nGear"), fill_channels=False)
    assert "RPM" not in out.columns and "nGear" in out.columns


def test_keep_and_require(spark):
    df = spark.createDataFrame([(1, "a", 2)], "Speed int, junk string, Driver int")
    assert keep_existing(df).columns == ["Speed", "Driver"]
    with pytest.raises(MissingColumnsError, match="RPM"):
        require_columns(df)
    assert require_columns(dirty(spark)) is not None


def test_dropped_rows(spark):
    row = C.dropped_rows(dirty(spark), ["session_file"]).first()
    assert (row.raw_rows, row.rows_dropped, row.row_count) == (100, 10, 90)
