"""Feature contract, deltas, flags and normalization."""

import pytest
from pyspark.sql import functions as F

from lapforge.operators.features import engineer_features
from lapforge.schema import DRIVER_KEYS, FEATURE_COLUMNS

SCHEMA = ("Year int, Round int, Session string, Driver string, Speed float, Throttle float, Brake float, "
          "RPM float, nGear int, SessionTime long, row_index long")


def build(spark, rows):
    full = [(2024, 1, "Q", r.get("d", "44"), float(r.get("s", 100)), float(r.get("t", 0)), float(r.get("b", 0)),
             float(r.get("rpm", 8000)), r.get("g", 4), r.get("at", i) * 10**9, i) for i, r in enumerate(rows)]
    return engineer_features(spark.createDataFrame(full, SCHEMA)).orderBy("row_index").collect()


def test_contract(spark):
    rows = build(spark, [{"s": 100 + i, "t": 80 * (i % 2), "b": 60 * (1 - i % 2)} for i in range(20)])
    df = spark.createDataFrame(rows)
    assert len(rows) == 20
    for c in FEATURE_COLUMNS:
        assert all(r[c] is not None for r in rows)
    assert set(FEATURE_COLUMNS) < set(df.columns) and set(DRIVER_KEYS) < set(df.columns)


def test_types(spark):
    out = engineer_features(spark.createDataFrame([], SCHEMA))
    assert {out.schema[c].dataType.simpleString() for c in FEATURE_COLUMNS} == {"float"}


@pytest.mark.parametrize("pair,expected", [((0, 380), 50), ((380, 0), -50), ((100, 120), 20)])
def test_speed_delta(spark, pair, expected):
    rows = build(spark, [{"s": s} for s in pair])
    assert [r.speed_delta for r in rows] == [0, expected]


@pytest.mark.parametrize("pair,expected", [((1, 8), 4), ((8, 1), 4), ((3, 4), 1), ((5, 5), 0)])
def test_gear_change(spark, pair, expected):
    assert [r.gear_change for r in build(spark, [{"g": g} for g in pair])] == [0, expected]


def test_single_row(spark):
    row = build(spark, [{}])[0]
    assert row.speed_delta == 0 and row.gear_change == 0


@pytest.mark.parametrize("brake,throttle,flag", [(3, 3, 0), (6, 6, 1), (50, 0, 0), (0, 50, 0), (5, 5, 0)])
def test_overlap(spark, brake, throttle, flag):
    assert build(spark, [{"b": brake, "t": throttle}])[0].brake_throttle_overlap == flag


def test_normalized(spark):
    row = build(spark, [{"s": 380, "t": 100, "b": 50, "rpm": 7500}])[0]
    assert (row.speed_normalized, row.throttle_intensity, row.brake_intensity, row.rpm_normalized) == (1, 1, 0.5, 0.5)


def test_deltas_follow_time_not_file_order_and_stay_in_the_driver(spark):
    rows = build(spark, [{"s": 30, "at": 2}, {"s": 10, "at": 0}, {"s": 300, "at": 1, "d": "1"}, {"s": 15, "at": 1}])
    assert [r.speed_delta for r in rows] == [15, 0, 0, 5]
