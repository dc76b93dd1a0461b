"""Model training and scoring runs (M3-M5) on a written feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazeline.operators import learn
from hazeline.operators.keyed_trees import KeyedTrees, train_keyed
from hazeline.session import materialized


def materialized_features(df: DataFrame, ts: str = "datetime", key: str = "sensor_id", value: str = "pm25") -> DataFrame:
    """Features written once to the shared folder: training reads them many times, and a lost executor
    re-reads files instead of repeating the windows."""
    return materialized(learn.model_features(df, ts, key, value), "features")


def model_quality(features: DataFrame, kind: str, **params) -> tuple[DataFrame, object]:
    """M3 + M4: one model over all sensors, RMSE and R2 per sensor on the later part of the data."""
    train, test = learn.split_by_time(features)
    model = learn.train_model(train, kind, **params)
    scored = learn.predict(model, test)
    return learn.regression_metrics(scored).withColumn("model", F.lit(kind)), model


def per_sensor_quality(features: DataFrame, kind: str, **params) -> tuple[DataFrame, KeyedTrees]:
    """M3 + M4: a model for every sensor, all trained at once; RMSE and R2 per sensor on the later part of the data."""
    train, test = learn.split_by_time(features)
    model = train_keyed(train, learn.FEATURES[:-1], kind=kind, **params)  # a sensor's number says nothing about itself
    return learn.regression_metrics(model.predict(test)).withColumn("model", F.lit(kind)), model
