"""Frame reduction, frame selection and rate sampling."""

import pytest

from lapforge.operators import frames as R
from lapforge.operators.sampling import sample_video_frames, select_frames

SCHEMA = ("video string, frame_number int, det_idx int, class_id int, confidence double, width int, height int, "
          "contours array<array<struct<x:int,y:int>>>")


def box(x, y, size=10):
    return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size)]]


def test_turn_of_the_last_curb_distance_of_the_nearest(spark):
    rows = [
        # frame 0: the first curb is near the right wheel, the last one lies left and far away
        ("v", 0, 0, 0, 0.9, 1000, 1000, box(845, 600)), ("v", 0, 1, 0, 0.9, 1000, 1000, box(0, 0)),
        # frame 1: road only; frame 2: a curb without area; frame 3: too uncertain
        ("v", 1, 0, 1, 0.9, 1000, 1000, box(0, 0)), ("v", 2, 0, 0, 0.9, 1000, 1000, [[(1, 1), (2, 2)]]),
        ("v", 3, 0, 0, 0.2, 1000, 1000, box(0, 0)), ("v", 4, 0, 0, 0.25, 1000, 1000, [])]
    found = spark.createDataFrame(rows, SCHEMA)
    listing = spark.createDataFrame([("v", i, 25.0) for i in range(6)], "video string, frame_number int, fps double")
    out = {r.frame_number: r for r in R.frame_metrics(listing, found).collect()}
    assert (out[0].turn_direction, out[0].distance_px, out[0].status) == ("Left", "5px", "Hitting Apex")
    assert (out[0].wheel.x, out[0].closest_point.x) == (850, 845)
    assert (out[1].has_curb, out[1].status, out[1].distance_px) == (False, "Straight", "N/A")
    # a curb without usable contour still counts as a curb frame
    assert (out[2].has_curb, out[2].status, out[2].distance_px, out[2].turn_direction) == (True, "Straight", "N/A", "Straight")
    assert out[3].has_curb is False and out[4].has_curb is True and out[5].status == "Straight"
    assert out[5].timestamp_sec == 0.2


def test_centre_is_left(spark):
    rows = [("v", 0, 0, 0, 0.9, 1000, 1000, box(495, 0)), ("v", 1, 0, 0, 0.9, 1000, 1000, box(496, 0))]
    out = {r.frame_number: r.turn for r in R.measure_curbs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: "Left", 1: "Right"}


def test_equal_distances_keep_the_first(spark):
    rows = [("v", 0, i, 0, 0.9, 1000, 1000, box(845, 600)) for i in (1, 0)]
    best = R.reduce_frames(R.measure_curbs(spark.createDataFrame(rows, SCHEMA))).first()
    assert best.distance == 5.0 and best.turn_direction == "Right"


def test_selection_counts_and_names(spark):
    videos = [("2023", "01_bahrain_ver_pole", 50), ("2023", "02_saudi_nor_pole", 30), ("2024", "01_bahrain_per_pole", 40),
              ("2024", "short", 4)]
    rows = [(y, v, f"frame_{i:05d}.jpg") for y, v, n in videos for i in range(1, n + 1)]
    out = select_frames(spark.createDataFrame(rows, "year string, video string, frame_name string"), 11).collect()
    counts = {}
    for r in out:
        counts[r.video, r.year] = counts.get((r.video, r.year), 0) + 1
    assert sorted(counts.values()) == [4, 11, 11, 11]
    assert "2023_01_bahrain_ver_pole_frame_00001.jpg" in {r.selected_name for r in out}
    for y, v, n in videos:
        names = [f"frame_{i:05d}.jpg" for i in range(1, n + 1)]
        assert sorted(r.frame_name for r in out if (r.year, r.video) == (y, v)) == names[::max(1, n // 11)][:11]


@pytest.mark.parametrize("fps,total,expected", [(30.0, 13, [0, 6, 12]), (0.0, 3, [0, 1, 2]), (3.0, 2, [0, 1]),
                                                (29.97, 11, [0, 5, 10]), (25.0, 0, [])])
def test_rate_sampling(spark, fps, total, expected):
    out = sample_video_frames(spark.createDataFrame([("v", fps, total)], "video string, fps double, total_frames long"), 5)
    rows = sorted((r.frame_number, r.file_name) for r in out.collect())
    assert rows == [(f, f"frame_{i:05d}.jpg") for i, f in enumerate(expected, 1)]


def test_long_video_is_listed_in_blocks(spark, monkeypatch):
    import lapforge.operators.sampling as sampling
    monkeypatch.setattr(sampling, "FRAME_BLOCK", 7)
    out = sample_video_frames(spark.createDataFrame([("v", 10.0, 99)], "video string, fps double, total_frames long"), 5)
    assert sorted(r.frame_number for r in out.collect()) == list(range(0, 99, 2))
