"""Streams against the same result computed in one batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F, types as T

from hazeline.operators.latest import latest_per_sensor
from hazeline.streaming import live, live as live_sources
from hazeline.streaming.keyed import KeyedTable


def _files(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    rows = [(i, i % 5, base + dt.timedelta(minutes=7 * i), float(i % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, sensor_id long, datetime timestamp, pm25 double")
    for part, (lo, hi) in enumerate([(0, 100), (100, 200), (200, 300)]):
        df.where(F.col("event_id").between(lo, hi - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    return df


def _stream(spark, tmp_path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .parquet(f"{tmp_path}/in"))


def test_latest_over_several_batches(spark, tmp_path):
    df = _files(spark, tmp_path)
    out = live.replay_latest(_stream(spark, tmp_path, df.schema), tie=["event_id"])
    expected = latest_per_sensor(df, tie=["event_id"])
    assert sorted(out.select(df.columns).collect()) == sorted(expected.collect())


def test_averages_equal_the_batch_and_count_redelivered_rows_once(spark, tmp_path):
    df = _files(spark, tmp_path)
    df.where("event_id BETWEEN 90 AND 110").coalesce(1).write.parquet(f"{tmp_path}/in/p9")
    out = live.replay_averages(_stream(spark, tmp_path, df.schema), lateness="48 hours", row_id=["event_id"])
    # the watermark ends 48 hours before the last reading, so close the windows with one late reading
    assert out.count() == 0
    spark.createDataFrame([(999, 0, dt.datetime(2025, 1, 9), 1.0)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/pz")
    out = live.replay_averages(_stream(spark, tmp_path, df.schema), lateness="48 hours", row_id=["event_id"])
    expected = df.groupBy(F.window("datetime", "1 hour").start.alias("s"), "sensor_id").agg(F.count("pm25").alias("n"),
                                                                                            F.avg("pm25").alias("m"))
    got = {(r["window_start"], r["sensor_id"]): (r["measurements_count"], r["pm25_mean"]) for r in out.collect()}
    assert got == {(r["s"], r["sensor_id"]): (r["n"], r["m"]) for r in expected.collect()}
    assert {r["risk_level"] for r in out.collect()} <= {"Unknown", "Good", "Moderate", "Unhealthy for Sensitive Groups",
                                                       "Unhealthy", "Very Unhealthy", "Hazardous"}


def test_hourly_files(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.csv").write_text("SET\ntimestamp,sensor_id,pm2.5\n2025-01-01 00:00:00,41,9\n")
    (tmp_path / "land" / "b.csv").write_text("SET\ntimestamp,sensor_id,pm2.5\n2025-01-01 01:00:00,41,NaN\n2025-01-01 00:30:00,45,3\n")
    stream = live.hourly_file_stream(spark, str(tmp_path / "land"), ["timestamp", "sensor_id", "pm2.5"])
    out = {r["sensor_id"]: r["pm25"] for r in live.replay_latest(stream).collect()}
    assert out == {41: None, 45: 3.0}


def test_a_folder_of_part_files_streams_like_one_file(spark, tmp_path):
    from hazeline.streaming.live import table_stream

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(40).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = table_stream(spark, str(tmp_path), "events")
    query = stream.writeStream.format("memory").queryName("folder_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("folder_stream").count() == 40


def _batches(spark, n=8):
    rng = random.Random(3)
    return [{rng.randrange(400): (b, rng.random()) for _ in range(60)} for b in range(n)]


def _frame(spark, batch):
    return spark.createDataFrame([(k, b, v) for k, (b, v) in batch.items()], "sensor_id long, seen int, pm25 double")


def _rows(table):
    return {r.sensor_id: (r.seen, r.pm25) for r in table.read().collect()}


def test_keyed_table_writes_in_proportion_to_changes(spark, tmp_path):
    first = {k: (-1, 0.0) for k in range(400)}
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8, share=0.5, least=30)
    want, written = {}, 0
    for i, batch in enumerate([first, *_batches(spark)]):
        table.write(_frame(spark, batch), i)
        want |= batch
        assert _rows(table) == want and table.read().columns == ["sensor_id", "seen", "pm25"]
        base = spark.read.parquet(f"{tmp_path}/t/base")
        written += len(batch) + base.where(F.col("version") == i).count()
    changes = 400 + sum(map(len, _batches(spark)))
    assert written <= 4 * changes  # a merge writes a bucket once its deltas are half of it
    left = spark.read.parquet(f"{tmp_path}/t/base").groupBy("bucket").agg(F.count_distinct("version").alias("n")).collect()
    assert all(r.n == 1 for r in left)  # superseded versions are gone


def test_keyed_table_after_a_restart(spark, tmp_path):
    """A batch that comes again, and a base that was written without its commit, change nothing."""
    first, second = {k: (0, float(k)) for k in range(100)}, {k: (1, -1.0) for k in range(0, 100, 3)}
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4, least=10, share=0.2)
    table.write(_frame(spark, first), 0)
    lost = _frame(spark, {5: (9, 99.0)}).withColumn("bucket", F.lit(1))
    lost.write.partitionBy("bucket").parquet(f"{tmp_path}/t/base/version=1")
    assert _rows(table) == first
    for _ in range(2):
        KeyedTable(spark, str(tmp_path / "t"), buckets=4, least=10, share=0.2).write(_frame(spark, second), 1)
        assert _rows(table) == first | second


def test_keyed_table_of_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    empty = _frame(spark, {1: (0, 1.0)}).limit(0)
    table.write(empty, 0)
    assert table.read(empty.schema).count() == 0


def test_a_silent_sensor_changes_its_source(spark, tmp_path):
    """Sensor 1 falls silent while sensor 2 goes on; with a later reading it is live again."""
    start = dt.datetime(2025, 1, 1)
    schema = "event_id long, sensor_id long, datetime timestamp, pm25 double"

    def deliver(name, rows):
        rows = [(i, s, start + dt.timedelta(seconds=t), float(v)) for i, (s, t, v) in enumerate(rows)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    deliver("p0", [(1, 0, 10), (2, 0, 20), (1, 60, 11), (2, 200, 21)])
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(f"{tmp_path}/in"))
    live, silent = (KeyedTable(spark, f"{tmp_path}/{n}", buckets=4) for n in ("live", "silent"))
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,)], "sensor_id long")
    means = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "sensor_id long, pm25 double")

    def now():
        live_run = live_sources.run_live_sources(stream, live, silent, f"{tmp_path}/state", tie=["event_id"])
        assert live_run is None
        gone = silent.read(T.StructType.fromDDL("sensor_id long, silent_from timestamp"))
        out = live_sources.current_sources(wanted, live.read(), gone, means)
        return {r.sensor_id: (r.source, r.pm25) for r in out.collect()}

    assert now() == {1: ("LIVE", 11.0), 2: ("LIVE", 21.0), 3: ("FILE", 7.0)}
    deliver("p1", [(2, 400, 22)])
    assert now() == {1: ("FILE", 5.0), 2: ("LIVE", 22.0), 3: ("FILE", 7.0)}
    deliver("p2", [(1, 410, 12)])
    assert now() == {1: ("LIVE", 12.0), 2: ("LIVE", 22.0), 3: ("FILE", 7.0)}
