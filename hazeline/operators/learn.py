"""Tree ensembles on rolling features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from hazeline.functions.numeric import epoch_micros
from hazeline.operators.quantiles import one_row, quantiles
from hazeline.operators.series import rolling_means

FEATURES = ("pm25_mean_3h", "pm25_mean_6h", "hour_of_day", "day_of_week", "sensor_number")
_READERS = {"random_forest": RandomForestRegressionModel, "gbt": GBTRegressionModel}


def model_features(df: DataFrame, ts: str = "datetime", key: str = "sensor_id", value: str = "pm25") -> DataFrame:
    """W12 features plus calendar parts; rows without a full 6-hour history are not usable and drop out."""
    base = df.select(key, ts, F.col(value).cast("double").alias("pm25"))
    rolled = rolling_means(base, (3, 6), "pm25", ts, (key,))
    return (rolled.withColumn("hour_of_day", F.hour(ts).cast("double"))
                  .withColumn("day_of_week", F.dayofweek(ts).cast("double"))
                  .withColumn("sensor_number", F.col(key).cast("double"))
                  .dropna(subset=["pm25", "pm25_mean_3h", "pm25_mean_6h"]))


def split_by_time(features: DataFrame, train_share: float = 0.8, ts: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Earlier rows train, later rows test: no reading from the future leaks into the model."""
    timed = features.withColumn("_us", epoch_micros(features, ts).cast("double"))
    cut = one_row(quantiles(timed, "_us", {"cut": train_share}, approx=True))["cut"]
    return timed.where(F.col("_us") <= cut).drop("_us"), timed.where(F.col("_us") > cut).drop("_us")


def train_model(train: DataFrame, kind: str = "random_forest", seed: int = 7, num_trees: int = 20, max_depth: int = 5,
                features: Sequence[str] = FEATURES):
    """M3: fit a forest or boosted trees with Spark's distributed trainer."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
    common = {"featuresCol": "features", "labelCol": "pm25", "maxDepth": max_depth, "seed": seed}
    if kind == "random_forest":
        trainer = RandomForestRegressor(numTrees=num_trees, **common)
    elif kind == "gbt":
        trainer = GBTRegressor(maxIter=num_trees, **common)
    else:
        raise ValueError(f"unknown model kind: {kind}")
    return trainer.fit(assembled.select("features", "pm25"))


def predict(model, rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return model.transform(assembled).drop("features")


def regression_metrics(predicted: DataFrame, keys: Sequence[str] = ("sensor_id",), label: str = "pm25",
                       prediction: str = "prediction") -> DataFrame:
    """M4: RMSE and R2 per key in one aggregation; R2 is NULL when the label does not vary."""
    err = F.col(label) - F.col(prediction)
    out = predicted.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("_sse"),
        (F.var_pop(label) * F.count(label)).alias("_sst"), F.count(F.lit(1)).alias("rows"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    return out.select(*keys, "rmse", r2.alias("r2"), "rows")


def feature_importance(spark, model, features: Sequence[str] = FEATURES) -> DataFrame:
    """M5: importance per feature, one row each (a handful of model parameters)."""
    weights = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")


def save_model(model, path: str) -> None:
    """Persist a fitted model."""
    model.write().overwrite().save(path)


def load_model(path: str, kind: str = "random_forest"):
    return _READERS[kind].load(path)
