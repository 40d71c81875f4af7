"""Distance to a line against all pieces, with outliers, gaps and missing lines."""

import math

import numpy as np
from pyspark.sql import functions as F

from lapforge.operators.racing_line import cell_lists, line_deviation, line_pieces, nearest_piece

KEYS = "Year int, Round int, Session string"


def brute(x, y, points):
    best = None
    for k in range(max(1, len(points) - 1)):
        (ax, ay, corner), (bx, by, _) = points[k], points[min(k + 1, len(points) - 1)]
        dx, dy = bx - ax, by - ay
        part = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        found = (round(math.hypot(x - ax - part * dx, y - ay - part * dy), 9), k, corner)
        best = min(best or found, found)
    return best


def test_nearest_piece_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    lines = {("Q"): [(float(40 * i), float(30 * math.sin(i)), f"T{i // 4}") for i in range(20)], "R": [(5.0, 5.0, "T0")]}
    points = [(2024, 1, s, i, x, y, c) for s, pts in lines.items() for i, (x, y, c) in enumerate(pts)]
    points += [(2024, 1, "R", 9, None, 1.0, "T9"), (2024, 1, "R", 8, float("nan"), 1.0, "T9")]
    samples = [(2024, 1, "QR"[i % 2], "1", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(300, 250, (300, 2)))]
    samples += [(2024, 1, "Q", "1", 900, 1e6, -3e5), (2024, 1, "Q", "1", 901, None, 1.0), (2024, 1, "Q", "1", 902, float("inf"), 1.0),
                (2024, 1, "none", "1", 903, 1.0, 1.0), (2024, 1, "Q", "1", 904, 40.0, 30 * math.sin(1))]
    pieces = line_pieces(spark.createDataFrame(points, KEYS + ", i int, X double, Y double, corner string"), ["i"])
    frame = spark.createDataFrame(samples, KEYS + ", Driver string, id int, X double, Y double")
    got = {r.id: (r.line_distance, r.piece, r.corner) for r in nearest_piece(frame, pieces).collect()}
    assert len(got) == len(samples)
    for _, _, session, _, i, x, y in samples:
        if i in (901, 902, 903):
            assert got[i] == (None, None, None)
        else:
            want = brute(x, y, lines[session])
            assert got[i][1:] == want[1:] and abs(got[i][0] - want[0]) < 1e-6
    rated = line_deviation(frame.where("id = 904"), pieces, ratings=(("excellent", 0.0), ("good", 1.0))).first()
    assert (rated.samples, rated.mean_distance, rated.rating) == (1, 0.0, "excellent")
    assert nearest_piece(frame.limit(0), pieces).collect() == []
    assert nearest_piece(frame, pieces.where("false")).where(F.col("line_distance").isNotNull()).count() == 0


def test_cells_list_few_pieces_of_a_long_line(spark):
    rng = np.random.default_rng(3)
    line = [(float(10 * i), float(40 * math.sin(i / 9)), f"T{i // 20}") for i in range(300)]
    points = [(2024, 1, "Q", i, x, y, c) for i, (x, y, c) in enumerate(line)]
    pieces = line_pieces(spark.createDataFrame(points, KEYS + ", i int, X double, Y double, corner string"), ["i"])
    samples = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 3000, 200), rng.normal(0, 60, 200))] * 2
    samples += [(5000.0, 9000.0), (-40.0, -700.0), (1000.0, 1000.0)]
    cells = spark.createDataFrame([(2024, 1, "Q", int(x // 25), int(y // 25), x, y) for x, y in samples],
                                  KEYS + ", _cx long, _cy long, X double, Y double")
    bounds = cells.groupBy("Year", "Round", "Session", "_cx", "_cy").agg(
        F.min("X").alias("_low_x"), F.max("X").alias("_high_x"), F.min("Y").alias("_low_y"), F.max("Y").alias("_high_y"))
    lists = {(r._cx, r._cy): {p.piece for p in r._near}
             for r in cell_lists(bounds, pieces, ["Year", "Round", "Session"], 100.0).collect()}
    assert len(lists) == bounds.count()
    for x, y in samples:
        assert brute(x, y, line)[1] in lists[int(x // 25), int(y // 25)]
    assert sum(map(len, lists.values())) < 20 * len(lists)
