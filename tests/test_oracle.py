"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from hazeline.plans.oracle import ORACLE
from hazeline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_random_or_trained_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == {
        "forecast_noisy", "random_sample", "rf_quality", "gbt_quality", "rf_importance",
        "sensor_forest_quality", "sensor_boosted_quality"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    found = differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
