"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hazeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    The time zone is pinned so wall-clock readings keep their meaning, AQE re-plans
    joins and partition sizes at run time, and the top-n-per-group pre-filter is
    allowed for the first-rows-per-file sizes used by the archive scan.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.window.group.limit.threshold": "100000",
        **conf,
    }
    for key, val in settings.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local mode may fall back to a fresh one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="hazeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; ``remove_written`` knows it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_written(spark: SparkSession) -> int:
    """Delete every table and file that this application has written below the shared folder, and tell how many.

    For the end of a job, once results are stored elsewhere: frames made before read these files and fail afterwards.
    """
    return sum(remove_path(spark, path) for path in _written.pop(spark.sparkContext.applicationId, []))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever file system its path names; False if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))


def still_written(spark: SparkSession, path: str) -> bool:
    """Whether a path of ``fresh_path`` has not been removed."""
    return path in _written.get(spark.sparkContext.applicationId, [])


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the files.

    For results that several later passes read: they prune columns on Parquet instead of repeating a
    shuffle, and a lost executor costs a re-read only. The files stay until ``remove_written``.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
