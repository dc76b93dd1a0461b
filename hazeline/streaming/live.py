"""Live readings as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hazeline.functions.columns import resolve_value
from hazeline.functions.numeric import null_if_nan
from hazeline.functions.risk import risk_band
from hazeline.operators.joins import live_or_archive
from hazeline.session import fresh_path
from hazeline.streaming.keyed import KeyedTable, run_updates


def event_time(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Watermarks need a timestamp with time zone semantics; NTZ columns are cast."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def hourly_file_stream(spark: SparkSession, landing_dir: str, columns: Sequence[str]) -> DataFrame:
    """Stream of landed hourly CSV files with the given header; marker and header lines drop out."""
    header = ",".join(columns)
    lines = spark.readStream.text(landing_dir).where(~F.trim("value").isin("", "SET", header))
    rows = lines.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in columns)).alias("r")).select("r.*")
    out = resolve_value(rows, "canonical")
    return (out.withColumn("datetime", F.try_to_timestamp("timestamp"))
               .withColumn("sensor_id", F.col("sensor_id").try_cast("bigint"))
               .withColumn("pm25", null_if_nan(F.col("pm25").try_cast("double"))))


def streaming_latest(stream: DataFrame, ts: str = "datetime", tie: Sequence[str] = (), key: str = "sensor_id") -> DataFrame:
    """The newest row per sensor, kept up to date; the state is one row per sensor."""
    rest = [c for c in stream.columns if c != key]
    return (stream.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_row")).select(key, "_row.*"))


def streaming_averages(stream: DataFrame, width: str = "1 hour", lateness: str = "2 hours", ts: str = "datetime",
                       key: str = "sensor_id", value: str = "pm25", row_id: Sequence[str] = ()) -> DataFrame:
    """R2: mean per sensor and window with its risk band, emitted once the watermark has passed the window.

    ``row_id`` names the columns that identify a reading; re-delivered readings inside the watermark
    are then counted once.
    """
    timed = event_time(stream, ts).withWatermark(ts, lateness)
    if row_id:
        timed = timed.dropDuplicatesWithinWatermark(list(row_id))
    mean = timed.groupBy(F.window(ts, width), key).agg(
        F.avg(value).alias("pm25_mean"), F.count(value).alias("measurements_count"))
    return mean.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       key, "pm25_mean", risk_band(F.col("pm25_mean")).alias("risk_level"), "measurements_count")


def silent_sensors(stream: DataFrame, idle: str = "300 seconds", lateness: str = "0 seconds", ts: str = "datetime",
                   key: str = "sensor_id") -> DataFrame:
    """When a sensor has fallen silent, emitted once no reading can come that is less than ``idle`` after its last.

    A session of readings closes by itself when the watermark has passed its end, so silence needs no reading to be
    noticed; the state is one open session per sensor.
    """
    timed = event_time(stream, ts).withWatermark(ts, lateness).where(F.col(key).isNotNull())
    closed = timed.groupBy(F.session_window(ts, idle).alias("_s"), key).agg(F.count(F.lit(1)).alias("readings"))
    return closed.select(key, F.col("_s.end").alias("silent_from"), "readings")


def run_live_sources(stream: DataFrame, live: KeyedTable, silent: KeyedTable, checkpoint: str, idle: str = "300 seconds",
                     lateness: str = "0 seconds", ts: str = "datetime", tie: Sequence[str] = ()) -> None:
    """Q1/J3 as a stream: keep the newest reading of each sensor, and when it last fell silent, up to date."""
    run_updates(streaming_latest(stream, ts, tie, live.key), live, f"{checkpoint}/live")

    def newest(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy(silent.key).agg(F.max("silent_from").alias("silent_from"))
        silent.write(rows, batch_id)

    (silent_sensors(stream, idle, lateness, ts, silent.key).writeStream.outputMode("append").foreachBatch(newest)
     .option("checkpointLocation", f"{checkpoint}/silent").trigger(availableNow=True).start().awaitTermination())


def current_sources(requested: DataFrame, live: DataFrame, silent: DataFrame, archive_mean: DataFrame, ts: str = "datetime",
                    key: str = "sensor_id", value: str = "pm25") -> DataFrame:
    """The live value of sensors that are not silent, else the archive mean, with the source, as ``live_or_archive``.

    A sensor is silent if it fell silent after its newest reading; a reading that comes later makes it live again.
    """
    rows = event_time(live.select(key, ts, value), ts).join(silent.select(key, "silent_from"), key, "left")
    heard = rows.where(F.col("silent_from").isNull() | (F.col("silent_from") <= F.col(ts))).drop("silent_from")
    return live_or_archive(requested, heard.select(key, value), archive_mean, key, value)


def replay_sources(stream: DataFrame, requested: DataFrame, archive_mean: DataFrame, **kwargs) -> DataFrame:
    """Q1/J3 run over everything available."""
    spark = stream.sparkSession
    live, silent = (KeyedTable(spark, fresh_path(spark, name)) for name in ("live", "silent"))
    run_live_sources(stream, live, silent, fresh_path(spark, "sources-state"), **kwargs)
    return current_sources(requested, live.read(stream.schema), silent.read(T.StructType.fromDDL("sensor_id long, silent_from timestamp")),
                           archive_mean)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append finished rows to a Parquet folder."""
    (stream.writeStream.outputMode("append").format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_snapshots(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available; each micro-batch writes the full current state to ``batch=<id>``.

    A repeated batch overwrites its own folder, so a restart leaves no half-written state behind.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.outputMode("complete").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def latest_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """The state written by the newest micro-batch; without one, an error that says so."""
    states = spark.read.parquet(path)
    return states.where(F.col("batch") == states.agg(F.max("batch")).scalar()).drop("batch")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table replayed as a file stream."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if f"/{name}.parquet/" in (batch.inputFiles() or [""])[0]:
        return stream.parquet(path)  # a folder of part files
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def replay_latest(stream: DataFrame, **kwargs) -> DataFrame:
    """R1 run over everything available in update mode, result as a table in the shared folder."""
    spark = stream.sparkSession
    table = KeyedTable(spark, fresh_path(spark, "latest"), kwargs.get("key", "sensor_id"))
    latest = streaming_latest(stream, **kwargs)
    run_updates(latest, table, fresh_path(spark, "latest-state"))
    return table.read(latest.schema)


def replay_averages(stream: DataFrame, **kwargs) -> DataFrame:
    """R2 run over everything available, result as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, "averages"), fresh_path(spark, "averages-state")
    run_append(streaming_averages(stream, **kwargs), out, state)
    return spark.read.parquet(out)
