"""Queries over a monthly CSV archive (S1-S11, S14, Q9, Q16, Q17) and their SQL twins.

The archive is written below the shared folder from the event and line item tables, once per session and table folder:
events as delivered (missing, negative and extreme values, repeated rows) in the months they are from, line items in
the months of their shipping dates. Months differ in the columns they have and in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazeline.operators import aggregate as A
from hazeline.sources import sinks, tables as S
from hazeline.sources.archive import Archive, scan_hourly_snapshot
from hazeline.sources.profile import archive_summary
from hazeline.session import fresh_path, still_written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FORMS = (("timestamp", "sensor_id", "pm2.5", "parameter", "pm2_5"), ("sensor_id", "pm2_5", "parameter", "timestamp", "pm2.5"),
         ("timestamp", "row_id", "pm2.5", "pm2_5", "sensor_id", "parameter"))
_written: dict[tuple[str, str], str] = {}

RAW = """r AS (SELECT event_id AS row_id, ts AS datetime, user_id AS sensor_id, event_type AS parameter,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' AND value < 5 THEN -value
       WHEN value > 250 THEN value + 1000 ELSE value END AS pm25 FROM events),
e AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE parameter = 'purchase'),
b AS (SELECT l_orderkey AS row_id, l_shipdate AS datetime, l_suppkey AS sensor_id, 'pm2.5' AS parameter, l_quantity AS pm25
  FROM lineitem),
a AS (SELECT * FROM e UNION ALL SELECT * FROM b),
s AS (SELECT s_suppkey AS sensor_id, CAST(s_nationkey AS BIGINT) AS station_id, n_name AS district_slug, r_name AS area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = f"WITH {RAW} {sql}"
        return fn
    return register


def archive_of(spark: SparkSession, d: str) -> Archive:
    """The archive of a table folder, written on first use."""
    key = spark.sparkContext.applicationId, d
    if key not in _written or not still_written(spark, _written[key]):
        folder = fresh_path(spark, "archive")
        delivered = S.raw_measurements(spark, d).select(
            F.col("datetime").alias("timestamp"), "sensor_id", F.col("pm25").alias("pm2.5"),
            F.col("event_type").alias("parameter"), F.col("event_id").alias("row_id"))
        bulk = S.bulk_measurements(spark, d).select(
            F.col("datetime").alias("timestamp"), "sensor_id", F.col("pm25").alias("pm2.5"),
            F.lit("pm2.5").alias("parameter"), F.col("l_orderkey").alias("row_id"))
        readings = delivered.unionByName(bulk).withColumn("pm2_5", F.col("`pm2.5`"))  # each loader has its own name for it
        sinks.write_archive(readings, f"{folder}/measurements", FORMS)
        sensors = S.sensors(spark, d).withColumnRenamed("sensor_id", "id")
        sensors.write.option("header", True).csv(f"{folder}/sensors.csv")
        _written[key] = folder
    return Archive(spark, _written[key], station_kind="long")


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_PERIOD = "CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month"
_CALENDAR = "CAST(datetime AS DATE) AS date, CAST(extract(hour FROM datetime) AS INTEGER) AS hour"
_VALID = "pm25 IS NOT NULL AND pm25 >= 0 AND pm25 < 1000"


@query("""SELECT DISTINCT printf('measurements_%04d_%02d.csv', year(datetime), month(datetime)) AS filename,
CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month, true AS exists FROM a""")
def archive_inventory(spark, d):
    return archive_of(spark, d).inventory().select("filename", "year", "month", "exists")


@query("""SELECT count(DISTINCT strftime(datetime, '%Y%m')) AS file_count,
(SELECT count(*) FROM s) AS sensor_count FROM a""")
def archive_totals(spark, d):
    return archive_summary(archive_of(spark, d)).select("file_count", "sensor_count")


@query(f"""SELECT {_PERIOD}, datetime, {_CALENDAR}, sensor_id, pm25, parameter FROM a
WHERE year(datetime) BETWEEN 1993 AND 1995 AND month(datetime) IN (1, 2, 12) AND sensor_id IN (1, 2, 3, 5, 8)""")
def archive_range(spark, d):
    rows = archive_of(spark, d).measurements(1993, 1995, [1, 2, 12], [1, 2, 3, 5, 8])
    return _ntz(rows, "datetime").select("year", "month", "datetime", "date", "hour", "sensor_id",
                                         F.col("`pm2.5`").alias("pm25"), "parameter")


@query(f"SELECT {_PERIOD}, datetime, {_CALENDAR}, sensor_id, pm25, parameter FROM e")
def archive_events(spark, d):
    """Every month of the events, with the values as they were delivered."""
    rows = archive_of(spark, d).measurements(2024)
    return _ntz(rows, "datetime").select("year", "month", "datetime", "date", "hour", "sensor_id",
                                         F.col("`pm2.5`").alias("pm25"), "parameter")


@query("""SELECT datetime, sensor_id, pm25 FROM e
QUALIFY row_number() OVER (PARTITION BY strftime(datetime, '%Y%m') ORDER BY datetime) <= 40""")
def archive_first_rows(spark, d):
    rows = archive_of(spark, d).measurements(2024, nrows_per_file=40)
    return _ntz(rows, "datetime").select("datetime", "sensor_id", F.col("`pm2.5`").alias("pm25"))


@query(f"""SELECT datetime, e.sensor_id, pm25, parameter, station_id, district_slug, area
FROM e LEFT JOIN s ON e.sensor_id = s.sensor_id WHERE {_VALID}""")
def archive_pm25(spark, d):
    rows = archive_of(spark, d).pm25(2024)
    return _ntz(rows, "datetime").select("datetime", "sensor_id", "pm25", "parameter", "station_id", "district_slug", "area")


@query(f"""SELECT CAST(datetime AS DATE) AS date, b.sensor_id, station_id, count(pm25) AS measurements_count,
min(pm25) AS pm25_min, max(pm25) AS pm25_max FROM b JOIN s ON b.sensor_id = s.sensor_id
WHERE {_VALID} AND year(datetime) = 1996 GROUP BY ALL""")
def archive_daily(spark, d):
    """Daily figures per sensor straight from a year of the archive."""
    archive = archive_of(spark, d)
    out = A.daily_sensor_stats(archive.pm25(1996, include_metadata=False), archive.sensors(), ("station_id",), min_rows=1)
    return out.select("date", "sensor_id", "station_id", "measurements_count", "pm25_min", "pm25_max")


@query("""SELECT datetime AS date, sensor_id, pm25 FROM b WHERE year(datetime) = 1997 AND pm25 >= 0""")
def archive_legacy(spark, d):
    rows = archive_of(spark, d).pm25_legacy(1997, include_metadata=False)
    return _ntz(rows, "date").select("date", "sensor_id", "pm25")


@query(f"SELECT {_PERIOD}, datetime AS date, sensor_id, pm25 FROM e WHERE {_VALID}")
def archive_tolerant(spark, d):
    return _ntz(archive_of(spark, d).pm25_tolerant(2024), "date").select("year", "month", "date", "sensor_id", "pm25")


@query("""SELECT datetime AS date, sensor_id, pm25 FROM e
WHERE datetime >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY AND datetime <= TIMESTAMP '2024-01-20 12:00:00'""")
def archive_recent(spark, d):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    rows = archive_of(spark, d).recent(7, as_of, ordered=False)
    return _ntz(rows, "date").select("date", "sensor_id", F.col("`pm2.5`").alias("pm25"))


@query("SELECT datetime, sensor_id, pm25 FROM b WHERE strftime(datetime, '%Y%m') = '199404'")
def archive_snapshot(spark, d):
    """One monthly file read as a landed snapshot."""
    archive = archive_of(spark, d)
    paths = [r["path"] for r in archive.inventory().where("filename = 'measurements_1994_04.csv'").select("path").collect()]
    return _ntz(scan_hourly_snapshot(spark, paths), "datetime").select("datetime", "sensor_id", "pm25")
