"""Registered queries of the text package against SQL, and the pipeline stage by stage."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
import corpus_pipeline
from hazeline.llm.oracle import ORACLE
from hazeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    found = differences(QUERIES[name](spark, SF), duck(SF), ORACLE[name])
    assert found is None, found


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialized(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4] and "n_tokens" in last.columns
