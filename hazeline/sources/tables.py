"""Parquet tables read as measurements and sensors (adapters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: user is the sensor, value the concentration."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("datetime"), F.col("user_id").alias("sensor_id"), "event_type",
        F.col("value").alias("pm25"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sensors: nation is station and district, region the city area.

    There are fewer suppliers than users, so part of the readings has no metadata.
    """
    return (table(spark, sf_dir, "supplier")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("sensor_id"), F.col("s_nationkey").alias("station_id"),
                    F.col("n_name").alias("district_slug"), F.col("r_name").alias("area")))


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they might be delivered: error events without value, small sign-up values with the wrong
    sign, spikes, and purchases delivered twice."""
    v = F.col("value")
    once = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("datetime"), F.col("user_id").alias("sensor_id"), "event_type",
        F.when(F.col("event_type") == "error", None).when((F.col("event_type") == "signup") & (v < 5), -v)
         .when(v > 250, v + 1000).otherwise(v).alias("pm25"))
    return once.unionAll(once.where(F.col("event_type") == "purchase"))


def sparse_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with long gaps: only clicks and views carry a value."""
    return measurements(spark, sf_dir).withColumn(
        "pm25", F.when(F.col("event_type").isin("click", "view"), F.col("pm25")))


def bulk_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings, the largest table: supplier is the sensor, quantity the concentration."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("datetime"), F.col("l_suppkey").alias("sensor_id"),
        F.col("l_quantity").alias("pm25"))
