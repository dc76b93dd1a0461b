"""CSV archives written into a fresh folder."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from hazeline.sources import profile, sinks
from hazeline.sources.archive import Archive, file_headers, read_header, rejected_files, scan_csv, scan_hourly_snapshot

JAN = """SET
timestamp,sensor_id,pm2.5,pm10
2025-01-01 00:00:00,41,10.5,20
2025-01-01 01:00:00,41,,21
2025-01-01 02:00:00,45,-3,22
2025-01-01 03:00:00,45,NaN,22
2025-01-02 04:00:00,99,1200,22
2025-01-02 05:00:00,50,7.5
"""
FEB = """SET
timestamp,sensor_id,humidity,pm2.5_corrected
2025-02-01 00:00:00,41,55,11.5
2025-02-01 01:00:00,45,60,12.5
"""
LONG = """SET
timestamp,sensor_id,pm2.5
2025-03-01 00:00:00,41,1.5
2025-03-01 01:00:00,41,2.5,9,9
2025-03-01 02:00:00,41,3.5
"""
BAD_TIME = """SET
timestamp,sensor_id,pm2.5
2025-04-01 00:00:00,41,1.5
yesterday,41,2.5
"""
NO_MARKER = """timestamp,sensor_id,pm2.5
2025-05-01 00:00:00,41,4.5
"""
SENSORS = """id,station_id,latitude,longitude,altitude,sensor_type,title,district_slug
41,7,40.1,44.5,1000,A,"Park, north",avan
45,8,40.2,44.6,900,B,School,nor-nork
"""


@pytest.fixture
def folder(tmp_path):
    meas = tmp_path / "measurements"
    meas.mkdir()
    for name, text in [("2025_01", JAN), ("2025_02", FEB), ("2025_03", LONG), ("2025_04", BAD_TIME),
                       ("2025_05", NO_MARKER), ("bad_name", JAN), ("2025", JAN)]:
        (meas / f"measurements_{name}.csv").write_text(text)
    (meas / "measurements_2025_06.csv").write_bytes(b"SET\ntimestamp;sensor_id;pm2.5\n2025-06-01 00:00:00;41;3\xe9\n")
    (meas / "notes.csv").write_text("x\n1\n")
    (tmp_path / "sensors.csv").write_text(SENSORS)
    return tmp_path


@pytest.fixture
def archive(spark, folder):
    return Archive(spark, str(folder))


def path(folder, name):
    return f"file:{folder}/measurements/measurements_{name}.csv"


def test_inventory(archive):
    rows = {r["filename"]: r for r in archive.inventory().collect()}
    assert len(rows) == 8 and "notes.csv" not in rows
    assert (rows["measurements_2025_02.csv"]["year"], rows["measurements_2025_02.csv"]["month"]) == (2025, 2)
    assert rows["measurements_bad_name.csv"]["year"] is None and rows["measurements_2025.csv"]["month"] is None
    assert rows["measurements_2025_01.csv"]["length"] == len(JAN)


def test_range_scan(archive):
    df = archive.measurements(2025, months=[1])
    assert df.count() == 6
    assert {"year", "month", "datetime", "date", "hour", "pm2.5", "pm10"} <= set(df.columns)
    short = df.where("sensor_id = 50").first()
    assert short["pm10"] is None and short["pm2.5"] == 7.5 and short["hour"] == 5
    assert df.where(F.isnan("`pm2.5`")).count() == 0
    assert archive.measurements(2025, months=[1], sensors=[41]).count() == 2
    assert archive.measurements(2025, months=[]).count() == 0
    assert archive.measurements(2019).count() == 0


def test_mixed_headers_do_not_shift(archive):
    df = archive.measurements(2025, months=[1, 2])
    feb = df.where("month = 2").orderBy("datetime").collect()
    assert [r["pm2.5_corrected"] for r in feb] == [11.5, 12.5]
    assert [r["humidity"] for r in feb] == [55.0, 60.0] and feb[0]["pm2.5"] is None


def test_first_candidate_only_versus_coalesce(archive):
    # only the first candidate column of the union is used
    assert archive.pm25((2025, 2025), [1, 2]).count() == 2
    assert archive.pm25((2025, 2025), [1, 2], mode="coalesce").count() == 4


def test_dataset_with_metadata(archive):
    rows = {r["sensor_id"]: r for r in archive.pm25(2025, [1]).collect()}
    assert set(rows) == {41, 50}
    assert rows[41]["location_name"] == "Park, north" and rows[41]["station_id"] == 7 and rows[50]["latitude"] is None
    assert "latitude" not in archive.pm25(2025, [1], include_metadata=False).columns


@pytest.mark.parametrize("policy,rows", [("fail_file", 0), ("skip_row", 2), ("permissive", 3)])
def test_too_long_rows(spark, folder, policy, rows):
    got = scan_csv(spark, [path(folder, "2025_03")], policy).orderBy("timestamp").collect()
    assert len(got) == rows
    if policy == "permissive":
        assert got[1]["pm2.5"] == 2.5


def test_a_bad_file_does_not_take_others_with_it(spark, folder, archive):
    assert archive.measurements(2025, months=[3, 4, 5]).count() == 1
    bad = rejected_files(spark, [path(folder, n) for n in ("2025_01", "2025_03", "2025_04")])
    assert {r["path"][-11:] for r in bad.collect()} == {"2025_03.csv", "2025_04.csv"}


def test_unreadable_time_is_null_when_tolerant(archive):
    rows = archive.measurements_tolerant(2025, months=[4]).orderBy("`pm2.5`").collect()
    assert [r["date"] is None for r in rows] == [False, True]
    assert "timestamp" not in rows[0].asDict()


def test_missing_marker_is_fine(archive):
    assert archive.measurements(2025, months=[5]).first()["pm2.5"] == 4.5


def test_first_rows_apply_before_the_sensor_filter(archive):
    assert archive.measurements(2025, months=[1], nrows_per_file=2).count() == 2
    assert archive.measurements(2025, months=[1], sensors=[50], nrows_per_file=2).count() == 0
    assert [r["pm2.5"] for r in archive.measurements(2025, months=[1], nrows_per_file=1).collect()] == [10.5]


def test_first_rows_hide_a_later_bad_row(spark, folder):
    assert scan_csv(spark, [path(folder, "2025_03")], "fail_file", nrows_per_file=1).count() == 1


def test_first_rows_follow_file_order_across_splits(spark, tmp_path):
    meas = tmp_path / "measurements"
    meas.mkdir()
    lines = [f"2025-01-01 00:00:00,{i},{i}" for i in range(5000)]
    (meas / "measurements_2025_01.csv").write_text("SET\ntimestamp,sensor_id,pm2.5\n" + "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = Archive(spark, str(tmp_path)).measurements(2025, nrows_per_file=1500)
        assert sorted(r["sensor_id"] for r in df.collect()) == list(range(1500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_legacy_scan(archive):
    df = archive.measurements_legacy(2025, months=[2, 1])
    assert "timestamp" not in df.columns and [r["date"] for r in df.collect()] == sorted(r["date"] for r in df.collect())
    with pytest.raises(ValueError):
        archive.measurements_legacy(2019)
    # an empty list means every month here
    assert archive.measurements_legacy(2025, months=[]).count() == archive.measurements_legacy(2025).count() > 6
    assert archive.measurements_legacy(2025, months=[1], sample=0.5, seed=1).count() < 6


def test_legacy_dataset(spark, tmp_path):
    meas = tmp_path / "measurements"
    meas.mkdir()
    (meas / "measurements_2024_01.csv").write_text(
        "timestamp,sensor_id,parameter,PM2.5\n2024-01-01 00:00:00,41,PM25,5\n2024-01-01 01:00:00,41,temp,6\n"
        "2024-01-01 02:00:00,42,pm2.5,-1\n2024-01-01 03:00:00,42,pm2.5,\n")
    (tmp_path / "sensors.csv").write_text("sensor_id,station_id,type,param\n41,7,A,pm25\n41,7,A,pm25\n43,8,B,pm25\n")
    old = Archive(spark, str(tmp_path))
    rows = old.pm25_legacy(2024).collect()
    assert [(r["sensor_id"], r["pm25"], r["sensor_type"]) for r in rows] == [("41", 5.0, "A")]
    assert rows[0]["parameter_x"] == "PM25" and rows[0]["parameter_y"] == "pm25"
    assert old.pm25_legacy(2024, clean_negative=False).count() == 3
    assert {r["sensor_id"] for r in old.pm25_legacy(2024, how="outer").collect()} == {"41", "43"}


def test_tolerant_dataset_and_sample(archive):
    assert archive.pm25_tolerant(2025).count() > 0
    assert archive.quick_sample(2025, 1, 3).count() == 3


def test_recent(archive):
    as_of = dt.datetime(2025, 5, 2)
    assert archive.recent(30, as_of).count() == 1
    # every month in reach is read: 04 is rejected, 06 has another delimiter, the others hold four rows
    assert archive.recent(3650, as_of).where("sensor_id = 41").count() == 4


def test_headerless_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2025-01-01 00:00:00,41,1.5\n2025-01-01 01:00:00,41,2.5\n")
    (tmp_path / "b.csv").write_text("date,sensor,pm25\n2025-01-01,41,1.5\n")
    assert read_header(spark, f"{tmp_path}/a.csv", True) == (("col_0", "col_1", "col_2"), False)
    assert read_header(spark, f"{tmp_path}/b.csv", True) == (("date", "sensor", "pm25"), True)
    assert scan_csv(spark, [f"{tmp_path}/a.csv"], "skip_row", allow_headerless=True).count() == 2


def test_quoted_commas_are_one_cell(spark, tmp_path):
    (tmp_path / "q.csv").write_text('SET\ntimestamp,sensor_id,title\n2025-01-01 00:00:00,1,"a, b"\n')
    assert scan_csv(spark, [f"{tmp_path}/q.csv"]).first()["title"] == "a, b"


def test_missing_places(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Archive(spark, str(tmp_path)).measurements(2025)
    (tmp_path / "measurements").mkdir()
    with pytest.raises(FileNotFoundError):
        Archive(spark, str(tmp_path)).measurements(2025)
    with pytest.raises(FileNotFoundError):
        Archive(spark, str(tmp_path)).sensors()


def test_hourly_snapshot(spark, tmp_path):
    (tmp_path / "h.csv").write_text("SET\ntimestamp,sensor_id,pm2.5,temperature\n2025-01-01 00:00:00,41,9,1.5\n")
    row = scan_hourly_snapshot(spark, [f"{tmp_path}/h.csv"]).first()
    assert row["pm25"] == 9.0 and row["pm2.5"] == 9.0 and row["datetime"] == dt.datetime(2025, 1, 1)


def test_summary(archive):
    row = profile.archive_summary(archive).first()
    assert row["file_count"] == 8 and row["years"] == [2025] and row["sensor_count"] == 2
    assert [f["filename"] for f in row["latest_files"]][-1] == "measurements_bad_name.csv" and len(row["latest_files"]) == 5


def test_structure_profile(spark, folder):
    out = {r["filename"]: r for r in profile.structure_profile(spark, [str(folder / "measurements")]).collect()}
    jan, jun, mar = (out[f"measurements_2025_0{m}.csv"] for m in (1, 6, 3))
    assert jan["lines"] == 7 and jan["inconsistent"] and jan["valid_utf8"] and jan["delimiter"] == "comma"
    assert jan["header"].startswith("timestamp") and jan["rows_after_skip"] == 6
    assert jun["delimiter"] == "semicolon" and not jun["valid_utf8"] and jun["encoding"] == "latin1"
    assert mar["rows_after_skip"] == 2 and mar["comma_max_cells"] == 5


def test_column_castability(spark, folder):
    out = {r["column"]: r for r in profile.column_castability(spark, [path(folder, "2025_01")]).collect()}
    assert not out["timestamp"]["castable"] and out["pm2.5"]["numeric_cells"] == 5 and out["pm10"]["cells"] == 5


def test_ingest_prunes_partitions(spark, archive, tmp_path):
    target = str(tmp_path / "table")
    archive.ingest(2025, target, months=[1, 2])
    df = sinks.read_measurements(spark, target).where("year = 2025 AND month = 2 AND pm25 > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThan(pm25,0.0)" in plan
    assert sinks.read_measurements(spark, target).count() == 8


def test_report_sink_keeps_line_order(spark, tmp_path):
    lines = spark.range(200).select((F.col("id") % 20).alias("section"), F.col("id").cast("int").alias("line_no"),
                                    F.concat(F.lit("l"), F.col("id")).alias("text"))
    sinks.write_report(lines, str(tmp_path / "report"))
    got = [line for p in sorted((tmp_path / "report").glob("part-*")) for line in p.read_text().splitlines()]
    assert got == [f"l{i}" for i in sorted(range(200), key=lambda i: (i % 20, i))]
    sinks.write_table(lines, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200


def test_unknown_text_and_large_ids_survive(spark, tmp_path):
    (tmp_path / "measurements").mkdir()
    (tmp_path / "measurements" / "measurements_2025_01.csv").write_text(
        "SET\ntimestamp,sensor_id,pm2.5,note\n2025-01-01 00:00:00,9007199254740993,5.5,windy\n")
    (tmp_path / "sensors.csv").write_text("id,station_id,model,city\n9007199254740993,ST-1,X200,Graz\n")
    row = Archive(spark, str(tmp_path)).pm25(2025).collect()[0]
    assert (row["sensor_id"], row["note"], row["station_id"], row["model"], row["city"]) == (
        9007199254740993, "windy", "ST-1", "X200", "Graz")


def test_recent_reads_every_month_it_needs(spark, tmp_path):
    (tmp_path / "measurements").mkdir()
    for month in range(1, 13):
        (tmp_path / "measurements" / f"measurements_2024_{month:02d}.csv").write_text(
            f"SET\ntimestamp,sensor_id,pm2.5\n2024-{month:02d}-15 00:00:00,1,5.0\n")
    archive = Archive(spark, str(tmp_path))
    assert archive.recent(365, F.lit("2024-12-31").cast("timestamp")).count() == 12
    assert archive.recent(40, F.lit("2024-06-20").cast("timestamp")).count() == 2


def test_second_ingest_keeps_other_periods(spark, tmp_path):
    (tmp_path / "measurements").mkdir()
    for year in (2023, 2024):
        (tmp_path / "measurements" / f"measurements_{year}_01.csv").write_text(
            f"SET\ntimestamp,sensor_id,pm2.5\n{year}-01-15 00:00:00,1,5.0\n")
    archive, out = Archive(spark, str(tmp_path)), str(tmp_path / "out")
    archive.ingest((2023, 2024), out)
    archive.ingest(2024, out)
    assert spark.read.parquet(out).count() == 2


def _jobs(spark, label, action):
    """How many Spark jobs an action takes."""
    spark.sparkContext.setJobGroup(label, label)
    try:
        result = action()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def _many_files(folder, n):
    orders = [("timestamp", "sensor_id", "pm2.5"), ("pm2.5", "timestamp", "sensor_id"), ("sensor_id", "humidity", "pm2.5", "timestamp")]
    for i in range(n):
        cell = {"timestamp": f"{2000 + i // 12}-{i % 12 + 1:02d}-01 00:00:00", "sensor_id": i, "pm2.5": i / 8, "humidity": i % 7}
        names = orders[i % 3]
        (folder / f"measurements_{2000 + i // 12}_{i % 12 + 1:02d}.csv").write_text(
            "SET\n" * (i % 2) + ",".join(names) + "\n" + ",".join(str(cell[c]) for c in names) + "\n")


def test_headers_of_a_thousand_files_take_as_many_jobs_as_of_forty(spark, tmp_path):
    counts = []
    for n in (40, 1000):  # beyond 32 paths Spark lists files by a job
        meas = tmp_path / str(n) / "measurements"
        meas.mkdir(parents=True)
        _many_files(meas, n)
        archive = Archive(spark, str(tmp_path / str(n)))
        rows, jobs = _jobs(spark, f"headers-{n}", lambda: archive.measurements(2000, 2100, on_bad="permissive").collect())
        counts.append(jobs)
        assert sorted((r.sensor_id, r["pm2.5"], r.humidity, r.year, r.month) for r in rows) == [
            (i, i / 8, float(i % 7) if i % 3 == 2 else None, 2000 + i // 12, i % 12 + 1) for i in range(n)]
    assert counts[0] == counts[1]


def test_header_of_a_file_cut_into_many_splits(spark, tmp_path):
    text = "\n \nSET\n\ufeff\"timestamp\" , sensor_id,pm2.5\n" + "".join(f"2025-01-01 00:00:00,{i},1\n" for i in range(400))
    (tmp_path / "a.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        found = file_headers(spark, [f"{tmp_path}/a.csv"]).collect()
        assert [r.cells for r in found] == [["timestamp", "sensor_id", "pm2.5"]]
        assert scan_csv(spark, [f"{tmp_path}/a.csv"]).count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_archive_comes_back(spark, tmp_path):
    rows = [(dt.datetime(2025, 1 + i % 3, 2, 3, i % 60), i % 7, i / 4 if i % 5 else None, 'say "a, b"' if i % 2 else None)
            for i in range(90)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, sensor_id long, `pm2.5` double, note string").repartition(5)
    forms = [("timestamp", "sensor_id", "pm2.5", "note"), ("note", "pm2.5", "timestamp", "sensor_id")]
    sinks.write_archive(df, f"{tmp_path}/measurements", forms, rows_per_file=10)
    archive = Archive(spark, str(tmp_path))
    assert [(r.filename, r.year, r.month) for r in archive.inventory().orderBy("month").collect()] == [
        (f"measurements_2025_0{m}.csv", 2025, m) for m in (1, 2, 3)]
    got = archive.measurements(2025).select(F.col("datetime").cast("timestamp_ntz"), "sensor_id", "`pm2.5`", "note")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    assert archive.measurements(2025, nrows_per_file=4).count() == 12


def test_ids_that_are_no_numbers_are_errors_when_keys_are_strict(spark, tmp_path):
    meas = tmp_path / "measurements"
    meas.mkdir()
    (meas / "measurements_2025_01.csv").write_text("SET\ntimestamp,sensor_id,pm2.5\n2025-01-01 00:00:00,x1,5\n2025-01-01 00:00:00,41,6\n")
    (tmp_path / "sensors.csv").write_text(SENSORS)
    archive = Archive(spark, str(tmp_path))
    with pytest.raises(Exception, match="missing sensor_id"):
        archive.pm25(2025).collect()
    loose = archive.pm25(2025, strict_keys=False)
    assert sorted((r.pm25, r.station_id) for r in loose.collect()) == [(5.0, None), (6.0, 7)]


def test_written_files_can_be_removed(spark, tmp_path, monkeypatch):
    from hazeline import session

    monkeypatch.setattr(session, "_written", {})
    df = session.materialized(spark.range(5), "some")
    path = session._written[spark.sparkContext.applicationId][0]
    assert df.count() == 5 and session.still_written(spark, path)
    assert session.remove_written(spark) == 1 and not session.still_written(spark, path)
    assert not (pathlib.Path(path.removeprefix("file:"))).exists() and session.remove_written(spark) == 0


def test_a_task_of_the_writer_gets_a_bounded_number_of_rows(spark, tmp_path):
    """However many months and rows, no task sorts and writes twice the rows of a file, and every file has its header first."""
    df = spark.range(24_000).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
                                    F.col("id").alias("sensor_id"), F.lit(1.5).alias("pm2.5"))
    sinks.write_archive(df, f"{tmp_path}/measurements", [("timestamp", "sensor_id", "pm2.5")], rows_per_file=1000)
    tasks = {}
    for part in pathlib.Path(tmp_path, "measurements").glob("file=*/part-*"):
        lines = part.read_text().splitlines()
        assert lines[:2] == ["SET", "timestamp,sensor_id,pm2.5"]
        times = [line.split(",")[0] for line in lines[2:]]
        assert times == sorted(times)
        task = part.name.split("-")[1]
        tasks[task] = tasks.get(task, 0) + len(times)
    assert sum(tasks.values()) == 24_000 and max(tasks.values()) < 2000
    assert len({str(p.parent) for p in pathlib.Path(tmp_path, "measurements").glob("file=*/part-*")}) == 33


def test_nothing_to_write_leaves_an_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([(None, 1)], "timestamp timestamp_ntz, sensor_id long")
    sinks.write_archive(df, f"{tmp_path}/measurements", [("timestamp", "sensor_id")])
    assert Archive(spark, str(tmp_path)).inventory().count() == 0


def test_a_line_is_parsed_once_and_its_file_name_never(archive, capsys):
    """Filters on cells do not repeat the parser, and the period is found per file, not per line."""
    df = archive.pm25_tolerant(2025)
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_csv(") == 1
    above_join = plan[:plan.index("Join")]
    assert "year" in df.columns and "measurements_(" not in above_join
    assert {(r.year, r.month) for r in df.collect()} >= {(2025, 1), (2025, 2)}
