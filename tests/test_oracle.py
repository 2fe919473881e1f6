import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

# Whole streaming runs and full fits take a minute each; other tests cover their parts, compare.py runs them all.
SLOW = {"stream_features", "stream_features_out_of_order", "stream_score_invariants", "model_invariants",
        "train_weighted_invariants", "stream_features_keyed_state", "replay_scored_in_time_order"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(queries()[name](spark, sf_dir), con, oracle_sql()[name]) is None


def test_difference_is_noticed(spark, con):
    assert difference(spark.range(2).withColumnRenamed("id", "a"), con, "select cast(range + 1 as bigint) as a from range(2)")
    assert difference(spark.range(2).withColumnRenamed("id", "a"), con, "select cast(range as bigint) as a from range(3)")
    assert difference(spark.range(2).withColumnRenamed("id", "a"), con, "select cast(range as integer) as a from range(2)")


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).limit(1).count() == 1
