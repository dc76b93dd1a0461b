"""Composite reports and models on the smallest tables, checked against pandas where it is quick."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.functions.columns import with_calendar
from hazeline.operators import learn
from hazeline.operators.joins import attach
from hazeline.plans import quality, reports as R
from hazeline.sources import sinks, tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    return S.measurements(spark, SF)


@pytest.fixture(scope="module")
def s(spark):
    return S.sensors(spark, SF)


@pytest.fixture(scope="module")
def pdf():
    p = pd.read_parquet(f"{SF}/events.parquet").rename(columns={"ts": "datetime", "user_id": "sensor_id", "value": "pm25"})
    return p


def test_known_sensors(spark):
    rows = R.sensor_listing(R.known_sensors(spark)).collect()
    assert len(rows) == 13 and rows[0]["district"] == "Ajapnyak" and rows[0]["sensor_id"] == 28
    assert {r["total_sensors"] for r in rows} == {13}
    assert [r["sensor_id"] for r in rows if r["district"] == "Shengavit"] == [11, 43]


def test_monthly_diagram(m, s, pdf):
    out = R.monthly_diagram(m, s)
    assert out["histogram"].agg(F.sum("frequency")).first()[0] == len(pdf)
    stats = out["stats"].first()
    assert stats["mean"] == pytest.approx(pdf["pm25"].mean()) and stats["pct_above_guideline"] == pytest.approx((pdf["pm25"] > 5).mean() * 100)
    hourly = out["hourly"].toPandas().set_index("hour")["pm25_mean"].sort_index()
    np.testing.assert_allclose(hourly, pdf.groupby(pdf["datetime"].dt.hour)["pm25"].mean())
    assert out["districts"].count() <= 8 and out["daily"].count() == pdf["datetime"].dt.date.nunique()


def test_sensor_timeseries(m, pdf):
    out = R.sensor_timeseries(m, 3)
    own = pdf[pdf["sensor_id"] == 3].sort_values("datetime")
    assert [r["pm25"] for r in out["series"].collect()] == own["pm25"].tolist()
    assert out["hourly"].count() == own["datetime"].dt.hour.nunique()


def test_district_comparison(m, s):
    out = R.district_comparison(m, s, attach(m, s), top_n=3)
    worst = [r["district_slug"] for r in out["districts"].collect()]
    assert len(worst) == 3 and {r["district_slug"] for r in out["boxes"].collect()} == set(worst)


def test_dashboard_and_quick_analysis(m, s, pdf):
    out = R.dashboard(m)
    assert out["summary"].first()["median"] == pytest.approx(pdf["pm25"].median())
    quick = R.quick_analysis(m, s, tie=["event_id"])
    assert [r["event_id"] for r in quick["series"].limit(3).collect()] == pdf.sort_values("datetime")["event_id"].head(3).tolist()
    assert quick["sensors"].count() == 3 and quick["quality"].first()["total_rows"] == len(pdf)
    assert quick["busiest"].first()["measurements"] == pdf["sensor_id"].value_counts().max()


def test_exploration(m, s, pdf):
    out = R.exploration(m, s, location=["area"])
    assert out["range"].first()["distinct_sensor_id"] == pdf["sensor_id"].nunique()
    best = pdf.groupby("sensor_id")["pm25"].mean().nlargest(5).index.tolist()
    assert [r["sensor_id"] for r in out["highest"].collect()] == best
    assert {r["sensor_id"] for r in out["daily"].select("sensor_id").distinct().collect()} == set(best)


def test_one_sensor_reading_and_advice(spark):
    latest = spark.createDataFrame([(41, 12.0), (45, 30.0)], "sensor_id int, pm25 double")
    assert R.one_sensor_reading(latest, 41).count() == 1
    out = {(r["sensor_id"], r["profile"]): r["advice"] for r in R.personal_advice(latest).collect()}
    assert len(out) == 8 and out[(41, "athlete")] == "OK for light training" and out[(45, "parent")] == "Keep children indoors"


def test_health_brief_lines(spark, tmp_path):
    t = "timestamp'2025-01-01 00:00:00'"
    df = spark.sql(f"SELECT 41 sensor_id, {t} datetime, 53.4D pm25 UNION ALL SELECT 99, {t}, 1D")
    brief = R.health_brief(df, R.known_sensors(spark))
    row = brief.first()
    assert brief.count() == 1 and row["mortality_excess_pct"] == 33.8 and row["district"] == "Avan"
    sinks.write_report(R.health_brief_lines(brief), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.splitlines()[-1] == "Sensor 41 (Avan): 53.4 µg/m³ - Hazardous"


def test_trend_needs_a_day_of_rows(m, pdf):
    out = R.trend(m, 7, tie=["event_id"])
    rich = pdf.groupby("sensor_id").size()
    assert {r["sensor_id"] for r in out.select("sensor_id").distinct().collect()} == set(rich[rich >= 24].index)
    assert out.groupBy("sensor_id").count().agg(F.max("count")).first()[0] <= 7


def test_models(spark, m, tmp_path):
    # a learnable signal: the value follows the hour of day
    df = m.withColumn("pm25", F.hour("datetime") * 2.0 + F.col("sensor_id") % 3)
    features = quality.materialized_features(df)
    assert features.count() > 100
    for kind in ("random_forest", "gbt"):
        metrics, model = quality.model_quality(features, kind, num_trees=8)
        assert metrics.where("rows > 5").agg(F.avg("rmse")).first()[0] < 6
        weights = learn.feature_importance(spark, model)
        assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1)
        assert weights.orderBy(F.desc("importance")).first()["feature"] in ("hour_of_day", "pm25_mean_3h", "pm25_mean_6h")
        learn.save_model(model, str(tmp_path / kind))
        again = learn.load_model(str(tmp_path / kind), kind)
        some = features.limit(5)
        a = [r["prediction"] for r in learn.predict(model, some).orderBy("datetime").collect()]
        assert a == [r["prediction"] for r in learn.predict(again, some).orderBy("datetime").collect()]
    with pytest.raises(ValueError):
        learn.train_model(features, "arima")


def test_time_split_keeps_the_future_out(spark, m):
    features = quality.materialized_features(with_calendar(m))
    train, test = learn.split_by_time(features)
    assert train.agg(F.max("datetime")).first()[0] < test.agg(F.min("datetime")).first()[0]
    assert 0.7 < train.count() / features.count() < 0.9


def test_per_sensor_models(m):
    df = m.withColumn("sensor_id", F.col("sensor_id") % 2).withColumn("pm25", F.hour("datetime") * 2.0 + F.col("sensor_id"))
    metrics, model = quality.per_sensor_quality(quality.materialized_features(df), "random_forest", n_trees=3, depth=3)
    assert sorted(r["sensor_id"] for r in metrics.collect()) == [0, 1]
    assert metrics.agg(F.min("r2")).first()[0] > 0.3 and model.table.count() == 2


def test_metrics_formula(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (1, 5.0, 4.0), (2, 4.0, 4.0)], "sensor_id int, pm25 double, prediction double")
    out = {r["sensor_id"]: r for r in learn.regression_metrics(df).collect()}
    assert out[1]["rmse"] == pytest.approx((2 / 3) ** 0.5) and out[1]["r2"] == pytest.approx(1 - 2 / 8) and out[2]["r2"] is None
