"""Files in, files out: schema repair per file, layout, idempotence, streaming."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators.laps import lap_features
from lapforge.plans.season import clean_season, lake_catalog, ledger_catalog
from lapforge.session import clear_scratch, cut_lineage, require_shared_folder, run_folder
from lapforge.sources import lake as io
from lapforge.sources.lake import path_exists, read_lake
from lapforge.sources.telemetry import lake_size, read_sessions, season_manifest
from lapforge.streaming.incremental import clean_new_files


def session(n=80, **extra):
    pdf = pd.DataFrame({
        "Driver": ["1"] * n, "Speed": [200.0] * n, "RPM": [8000.0] * n, "Throttle": [50.0] * n, "Brake": [0.0] * n,
        "X": [1.0] * n, "Y": [2.0] * n, "nGear": [5] * n, "SessionTime": pd.to_timedelta(range(n), unit="s")})
    return pdf.assign(**extra)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    session(Date=pd.Timestamp("2024-03-01 12:00:00.123456789")).to_parquet(folder / "2024_1_Q.parquet")
    session().drop(columns=["nGear", "Driver"]).to_parquet(folder / "2024_2_R.parquet")
    gap = session(50)
    gap.loc[10:14, ["Speed", "RPM", "X", "Y"]] = None
    gap.loc[20, "Speed"] = None
    gap.drop(index=[3]).to_parquet(folder / "2023_7_Sprint.parquet")
    session(0).to_parquet(folder / "2023_8_R.parquet")
    return str(folder)


def test_repair_is_per_file(spark, landing):
    rows = read_sessions(spark, landing)
    assert "__index_level_0__" not in rows.columns
    by = {r.session_file: r for r in rows.groupBy("session_file").agg(
        F.count("*").alias("n"), F.min("nGear").alias("gear"), F.min("Driver").alias("driver"), F.max("Time").alias("t"),
        F.max("SessionTime").alias("st"), F.max("Year").alias("y"), F.max("Round").alias("r"), F.max("Session").alias("s"),
        F.max("Date").alias("d")).collect()}
    assert set(by) == {"2024_1_Q", "2024_2_R", "2023_7_Sprint"}
    assert (by["2024_1_Q"].gear, by["2024_1_Q"].driver) == (5, "1")
    assert (by["2024_2_R"].gear, by["2024_2_R"].driver) == (8, "UNKNOWN")
    assert by["2024_1_Q"].t == 79 * 10**9 and by["2024_1_Q"].st == 79 * 10**9
    assert (by["2023_7_Sprint"].y, by["2023_7_Sprint"].r, by["2023_7_Sprint"].s) == (2023, 7, "Sprint")
    assert str(by["2024_1_Q"].d).startswith("2024-03-01 12:00:00.123456")


def test_glob_and_missing(spark, landing):
    assert read_sessions(spark, landing + "/2024_*").select("session_file").distinct().count() == 2
    with pytest.raises(Exception):
        read_sessions(spark, landing + "/1999_*")


def test_clean_season_skips_and_forces(spark, landing, tmp_path):
    lake = str(tmp_path / "lake")
    assert clean_season(spark, landing, lake).count() == 80 + 80 + 44
    # only the session without rows is still open, and it adds nothing
    assert clean_season(spark, landing, lake).count() == 0
    stored = io.read_lake(spark, lake)
    assert stored.count() == 204
    assert stored.where("Speed is null").count() == 0
    assert clean_season(spark, landing, lake, force=True) is not None
    assert io.read_lake(spark, lake).count() == 204
    row = lake_catalog(spark, landing, io.read_lake(spark, lake)).where("session_file = '2023_7_Sprint'").first()
    assert (row.raw_rows, row.row_count, row.rows_dropped) == (49, 44, 5) and row.file_size_mb > 0


def test_ledger_stands_for_the_lake(spark, landing, tmp_path, monkeypatch):
    """One row per session with its rows, bytes and times; a further run neither reads the lake nor the sessions done."""
    lake = str(tmp_path / "lake")
    clean_season(spark, landing, lake)
    rows = {r.session_file: r for r in ledger_catalog(spark, lake).collect()}
    assert set(rows) == {"2024_1_Q", "2024_2_R", "2023_7_Sprint"}
    found = rows["2023_7_Sprint"]
    assert (found.Year, found.Round, found.Session, found.raw_rows, found.row_count, found.rows_dropped) == (2023, 7, "Sprint", 49, 44, 5)
    file = tmp_path / "landing" / "2023_7_Sprint.parquet"
    assert round(found.file_size_mb * 1048576) == file.stat().st_size
    assert abs(found.ingested_at.timestamp() - file.stat().st_mtime) < 1 and found.cleaned_at >= found.ingested_at
    monkeypatch.setattr(io, "read_optional", None)  # the lake itself is not asked
    session(30).to_parquet(landing + "/2024_3_Q.parquet")
    assert clean_season(spark, landing, lake).select("session_file").distinct().count() == 1
    assert ledger_catalog(spark, lake).count() == 4 and io.read_lake(spark, lake).count() == 234
    clean_season(spark, landing, lake, force=True)  # entries of later runs count
    assert ledger_catalog(spark, lake).count() == 4
    with pytest.raises(FileNotFoundError):
        ledger_catalog(spark, str(tmp_path / "none"))


def test_absent_and_null_columns_differ(spark, tmp_path):
    """Files of equal types are read in one scan: an absent channel is repaired, an all-NULL one is not, values survive."""
    whole = session(4).assign(Time=pd.to_timedelta(range(4), unit="s"))
    whole.to_parquet(tmp_path / "2024_1_Q.parquet")
    whole.drop(columns=["Speed", "Time", "nGear"]).to_parquet(tmp_path / "2024_2_Q.parquet")
    whole.assign(Speed=float("nan"), Driver=[None, "7", None, "7"]).astype({"Speed": "float64"}).to_parquet(tmp_path / "2024_3_Q.parquet")
    whole.drop(columns=["SessionTime", "Driver"]).to_parquet(tmp_path / "2024_4_Q.parquet")
    rows = read_sessions(spark, str(tmp_path))
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("Union") == 0
    by = {r.session_file: r for r in rows.groupBy("session_file").agg(
        F.collect_set("Speed").alias("speed"), F.collect_set("Driver").alias("driver"), F.max("Time").alias("t"),
        F.max("SessionTime").alias("st"), F.collect_set("nGear").alias("gear")).collect()}
    assert [by[f"2024_{k}_Q"].speed for k in (1, 2, 3, 4)] == [[200.0], [0.0], [], [200.0]]
    assert [by[f"2024_{k}_Q"].driver for k in (1, 2, 3, 4)] == [["1"], ["1"], ["7"], ["UNKNOWN"]]
    assert {(r.t, r.st) for r in by.values()} == {(3 * 10**9, 3 * 10**9)} and by["2024_2_Q"].gear == [8]
    bare = read_sessions(spark, str(tmp_path), fill_channels=False).where("session_file = '2024_2_Q'").first()
    assert bare.Speed is None and bare.nGear == 8


def test_other_file_names_keep_their_own_partition(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    session(5).to_parquet(folder / "shakedown.parquet")
    session(6).to_parquet(folder / "2024_test_day_two.parquet")
    lake = str(tmp_path / "lake")
    clean_season(spark, str(folder), lake)
    rows = {(r.Year, r.Session, r["count"]) for r in io.read_lake(spark, lake).groupBy("Year", "Session").count().collect()}
    assert rows == {(None, "shakedown", 5), (None, "2024_test_day_two", 6)}
    assert clean_season(spark, str(folder), lake) is None


def test_new_session_is_the_only_one_cleaned(spark, landing, tmp_path):
    lake = str(tmp_path / "lake")
    clean_season(spark, landing, lake)
    session(30).to_parquet(landing + "/2024_3_Q.parquet")
    added = clean_season(spark, landing, lake)
    assert {r.session_file for r in added.select("session_file").distinct().collect()} == {"2024_3_Q"}
    assert io.read_lake(spark, lake).count() == 234


def test_stream_processes_each_file_once(spark, landing, tmp_path):
    lake, ledger = str(tmp_path / "lake"), str(tmp_path / "ledger")
    assert clean_new_files(spark, landing, lake, ledger) == 1
    assert clean_new_files(spark, landing, lake, ledger) == 0
    session(30).to_parquet(landing + "/2024_3_Q.parquet")
    assert clean_new_files(spark, landing, lake, ledger) == 1
    assert io.read_lake(spark, lake).count() == 234


def test_late_part_file_completes_its_session(spark, tmp_path):
    folder = tmp_path / "landing" / "session_file=2024_9_Q"
    folder.mkdir(parents=True)
    lake, ledger = str(tmp_path / "lake"), str(tmp_path / "ledger")
    session(10).to_parquet(folder / "part-00000.parquet")
    clean_new_files(spark, str(tmp_path / "landing"), lake, ledger)
    later = session(10)
    later.loc[0, "Speed"] = None
    later["SessionTime"] += pd.Timedelta(seconds=10)
    later.to_parquet(folder / "part-00001.parquet")
    assert clean_new_files(spark, str(tmp_path / "landing"), lake, ledger) == 1
    rows = io.read_lake(spark, lake)
    assert rows.count() == 20 and rows.where("Speed is null").count() == 0
    assert rows.select("Year", "Round", "Session").distinct().collect() == [(2024, 9, "Q")]


def test_partition_and_row_group_pruning(spark, landing, tmp_path):
    lake = str(tmp_path / "lake")
    clean_season(spark, landing, lake)
    query = io.read_lake(spark, lake).where("Year = 2024 and Driver = '1'").select("Speed")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan and "EqualTo(Driver,1)" in plan
    assert "ReadSchema: struct<Speed:float,Driver:string>" in plan


def test_optional_reads(spark, tmp_path):
    for read in (io.read_optional, io.read_meta, io.read_metrics):
        assert read(spark, str(tmp_path / "nothing")) is None


def test_metrics_round_trip(spark, tmp_path):
    rows = [("v", 0, 0.0, "123px", "Hitting Apex", True), ("v", 1, 0.04, "N/A", "Straight", False)]
    df = spark.createDataFrame(rows, "video string, frame_number int, timestamp_sec double, distance_px string, status string, has_curb boolean")
    io.write_metrics(df, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").rglob("*.csv"))
    assert "frame_number,timestamp_sec,distance_px,status,has_curb" in text and "True" in text
    back = io.read_metrics(spark, str(tmp_path / "m")).orderBy("frame_number").collect()
    assert [(r.distance_px, r.has_curb) for r in back] == [(123.0, True), (None, False)]


def test_manifest(spark):
    seasons = spark.createDataFrame([(2023,), (2024,)], "Year int")
    schedule = spark.createDataFrame([(2023, 1), (2023, 3)], "Year int, RoundNumber int")
    got = {(r.Year, r.Round, r.Session) for r in season_manifest(seasons, schedule).collect()}
    assert len(got) == 3 * 2 + 24 * 2 and (2023, 3, "R") in got and (2023, 4, "Q") not in got


def test_lake_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"x" * 1024 * 1024)
    (tmp_path / "b.txt").write_bytes(b"x" * 512 * 1024)
    assert lake_size(spark, str(tmp_path)).first().lake_size == "1.50 MB"


def test_report(spark):
    df = spark.createDataFrame([("Round 1", 2024, "Max", "1", 10, 301.25, None)],
                               "session_label string, Year int, driver_name string, Driver string, total_rows long, top_speed double, output_file string")
    text = io.report_text(df).first().report
    assert text.splitlines()[2:] == ["Session: Round 1", "Year: 2024", "Driver: Max (#1)", "Total rows: 10", "Top Speed: 301.2 km/h"]


def test_times_go_on_over_part_files(spark, tmp_path):
    folder = tmp_path / "2024_1_Q.parquet"
    folder.mkdir()
    for number, speeds in ((99999, [5.0, 6.0, 7.0]), (100000, [8.0, 9.0]), (7, [1.0, 2.0, 3.0])):
        pd.DataFrame({"Driver": "1", "Speed": speeds}).to_parquet(folder / f"part-{number:05d}.parquet")
    rows = read_sessions(spark, str(tmp_path)).orderBy("SessionTime").collect()
    assert [r.SessionTime // 10**9 for r in rows] == list(range(8))
    assert [r.Speed for r in rows] == [1.0, 2.0, 3.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_driver_text_survives_folders(spark, tmp_path):
    rows = spark.createDataFrame([(2024, 1, "01", "07", 1)], "Year int, Round int, Session string, Driver string, x int")
    rows.write.partitionBy("Year", "Round", "Session", "Driver").parquet(str(tmp_path / "lake"))
    row = read_lake(spark, str(tmp_path / "lake")).first()
    assert (row.Session, row.Driver, row.Year, row.x) == ("01", "07", 2024, 1)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            require_shared_folder(master)
    for master in ("local", "local[*]", "local[8]"):
        require_shared_folder(master)


def test_scratch_is_cleared(spark):
    df = cut_lineage(spark.range(3), "probe")
    assert df.count() == 3
    clear_scratch(spark)
    assert not path_exists(spark, run_folder(spark))


def test_laps_without_samples_keep_their_number(spark):
    laps = spark.createDataFrame([(2024, 1, "R", "1", 1, n, "SOFT") for n in (1, 2, 3)],
                                 "Year int, Round int, Session string, Driver string, Stint int, LapNumber int, Compound string")
    samples = spark.createDataFrame([(1, 100.0, 1.0, 0.0), (3, 200.0, 2.0, 0.0)], "LapNumber int, Speed double, Throttle double, Brake double")
    rows = lap_features(samples, laps, ["LapNumber"]).orderBy("LapNumber").collect()
    assert [(r.lap_in_stint, r.mean_speed) for r in rows] == [(1, 100.0), (2, None), (3, 200.0)]
