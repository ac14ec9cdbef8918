"""Joins of rows with the facts of their group."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import joins, ordered
from tracewell.operators.ordered import attach_facts, spread_hot

HOT = 5_000


@pytest.fixture(scope="module")
def rows(spark):
    """Key 7 and the null key are hot, 1000 others have two rows each."""
    r = spark.range(2 * HOT + 2_000).withColumn("k", F.when(F.col("id") < HOT, 7).when(F.col("id") >= HOT + 2_000, None).otherwise(100 + F.col("id") % 1000))
    return r.repartition(4).cache()


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(k, f"f{k}") for k in [7, None, *range(100, 3_000)]], "k long, f string").cache()


def test_only_facts_of_hot_keys_are_copied(rows, facts):
    left, right, on = spread_hot(rows, facts, ["k"], 8)
    assert on == ["k", "_salt"] and right.count() == 2_900 + 2 * 8
    held = Counter({(r.k, r._salt): r["count"] for r in left.groupBy("k", "_salt").count().collect()})
    assert all(held[7, s] > HOT / 16 and held[None, s] > HOT / 16 for s in range(8))
    assert {s for k, s in held if k not in (7, None)} == {0}


def test_many_facts_travel_once(rows, facts):
    """Copies of all facts would be sent to every task, as their number is not known when the join is planned."""
    joined = attach_facts(rows.where("k <> 7"), facts, ["k"])
    assert "explode" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 2_000


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("counted", [True, False])
def test_same_rows_as_a_plain_join(rows, facts, how, counted):
    known = facts.where("k IS NULL OR k % 3 <> 0")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")) if counted else None
    got = attach_facts(rows, known, ["k"], how=how, counts=counts)
    want = ordered.join_facts(rows, known, ["k"], how)
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())


def test_epochs_of_a_hot_station(spark, rows):
    epochs = spark.createDataFrame([(7, 0, 2_500), (7, 2_500, None), (150, 0, None)], "k long, start long, end long")
    got = joins.attach_epoch(rows, epochs, ["k"], "id").groupBy("k", "start").count().collect()
    assert sorted(map(tuple, got)) == [(7, 0, 2_500), (7, 2_500, 2_500), (150, 0, 2)]
