"""Tree models for all keys at once against a plain tree grown key by key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazeline.operators import keyed_trees as T
from hazeline.operators.learn import regression_metrics

SCALE = T.SCALE


def brute_tree(rows, depth, min_rows):
    """rows: (bins, target as whole number). Returns a function from bins to the leaf's value."""
    def split(part):
        total, n, best = sum(y for _, y in part), len(part), None
        for f in range(len(part[0][0])):
            for b in sorted({x[f] for x, _ in part}):
                left = [y for x, y in part if x[f] <= b]
                nl, nr, sl = len(left), n - len(left), sum(left)
                if nl >= min_rows and nr >= min_rows and nr:
                    gain = float(sl) * float(sl) / nl + float(total - sl) * float(total - sl) / nr
                    gain -= (float(sl) + float(total - sl)) * (float(sl) + float(total - sl)) / n
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, f, b
        return best

    def grow(part, left):
        best = split(part) if left else None
        if best is None:
            value = sum(y for _, y in part) / len(part) / SCALE
            return lambda x: value
        _, f, b = best
        low, high = grow([r for r in part if r[0][f] <= b], left - 1), grow([r for r in part if r[0][f] > b], left - 1)
        return lambda x: low(x) if x[f] <= b else high(x)

    return grow(rows, depth)


def readings(n=400, keys=5):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randrange(keys)
        hour, day = rng.randrange(24), rng.randrange(7)
        rows.append((key, float(hour), float(day) if i % 11 else None, round(10 * key + hour * (day % 3) + rng.random() * 5, 2)))
    return rows


LEVELS = {"hour": range(24), "day": range(7)}


def bins(hour, day):
    return [int(hour), -1 if day is None else int(day)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(readings() + [(None, 1.0, 1.0, 5.0), (9, 1.0, 1.0, None)],
                                 "sensor_id long, hour double, day double, pm25 double").repartition(3)


@pytest.mark.parametrize("depth,min_rows", [(0, 1), (1, 1), (3, 4)])
def test_trees_equal_trees_grown_one_by_one(frame, depth, min_rows):
    model = T.train_keyed(frame, ["hour", "day"], kind="tree", depth=depth, min_rows=min_rows, levels=LEVELS)
    by_key = {}
    for key, hour, day, y in readings():
        by_key.setdefault(key, []).append((bins(hour, day), round(y * SCALE)))
    trees = {k: brute_tree(part, depth, min_rows) for k, part in by_key.items()}
    got = model.predict(frame.where("sensor_id is not null and pm25 is not null")).collect()
    assert len(got) == len(readings())
    for r in got:
        assert r.prediction == pytest.approx(trees[r.sensor_id](bins(r.hour, r.day)), abs=1e-9)


def test_boosted_trees_equal_boosting_key_by_key(frame):
    rate, depth = 0.5, 2
    model = T.train_keyed(frame, ["hour", "day"], kind="gbt", n_trees=3, depth=depth, min_rows=2, rate=rate, levels=LEVELS)
    want = {}
    for key in range(5):
        part = [(bins(h, d), y) for k, h, d, y in readings() if k == key]
        base = sum(round(y * SCALE) for _, y in part) / len(part) / SCALE
        trees = []

        def value(x, trees=trees, base=base):
            return base + rate * sum(t(x) for t in trees)
        for _ in range(3):
            trees.append(brute_tree([(x, math.floor((y - value(x)) * SCALE + 0.5)) for x, y in part], depth, 2))
        want[key] = value
    for r in model.predict(frame.where("sensor_id is not null and pm25 is not null")).collect():
        assert r.prediction == pytest.approx(want[r.sensor_id](bins(r.hour, r.day)), abs=1e-4)


def test_forest_learns_and_repeats(frame):
    first = T.train_keyed(frame, ["hour", "day"], kind="random_forest", n_trees=12, depth=4, seed=3)
    again = T.train_keyed(frame.repartition(5), ["hour", "day"], kind="random_forest", n_trees=12, depth=4, seed=3)
    scored = first.predict(frame)
    assert sorted(map(tuple, scored.na.fill(-1).collect())) == sorted(map(tuple, again.predict(frame).na.fill(-1).collect()))
    metrics = regression_metrics(scored.where("pm25 is not null")).collect()
    assert len(metrics) == 5 and all(m.r2 > 0.4 for m in metrics)
    shares = first.importance().groupBy("sensor_id").agg(F.sum("importance").alias("s"), F.count("feature").alias("n")).collect()
    assert all(abs(s.s - 1) < 1e-9 and s.n == 2 for s in shares)


def test_jobs_depend_on_depth_and_not_on_keys(spark):
    counts = []
    for keys in (3, 605):
        df = spark.range(keys * 4).select((F.col("id") % keys).alias("sensor_id"), (F.col("id") % 7).cast("double").alias("x"),
                                          (F.col("id") % 13).cast("double").alias("pm25"))
        label = f"trees-{keys}"
        spark.sparkContext.setJobGroup(label, label)
        model = T.train_keyed(df, ["x"], kind="tree", depth=2)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(label)))
        spark.sparkContext.setJobGroup("rest", "rest")
        assert model.table.count() == keys
    assert counts[0] == counts[1]


def test_unknown_kinds_and_empty_tables(spark, frame):
    with pytest.raises(ValueError):
        T.train_keyed(frame, ["hour"], kind="linear")
    model = T.train_keyed(frame.limit(0), ["hour"], kind="tree", depth=2)
    assert model.predict(frame).count() == 0 and model.importance().count() == 0


def test_a_level_pass_is_plain_column_work(spark, frame, monkeypatch, capsys):
    """Rows go down the trees without lambdas, cells are made for tried features only, and no level repeats the one before."""
    plans, written = [], T.materialized

    def noted(df, label):
        if label == "splits":
            df.explain()
            plans.append(capsys.readouterr().out)
        return written(df, label)
    monkeypatch.setattr(T, "materialized", noted)
    T.train_keyed(frame, ["hour", "day"], kind="random_forest", n_trees=4, depth=4, levels=LEVELS)
    assert len(plans) == 4
    for plan in plans:
        assert "aggregate(sequence" not in plan and "exists(" not in plan  # the walk, and what a node tries
    steps = [plan.count("isnull(") for plan in plans]
    assert steps[3] <= 3 * max(1, steps[1])


def test_every_node_tries_its_own_few_features(spark):
    for level in (0, 2):
        got = T._tried(spark, 5, level, 7, (2, 4)).collect()
        assert sorted((r["_tree"], r["_node"]) for r in got) == [(t, n) for t in range(5) for n in range(2**level - 1, 2**(level + 1) - 1)]
        assert all(len(set(r["_f"])) == 2 and set(r["_f"]) <= set(range(4)) for r in got)
    assert len({tuple(r["_f"]) for r in got}) > 1
    assert {tuple(sorted(r["_f"])) for r in T._tried(spark, 1, 1, 7, (3, 3)).collect()} == {(0, 1, 2)}
