"""Positions in the order of any whole numbers: outliers, the full range, skew, nulls, repeated and equal ids."""

import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import prefix, sequence
from strophe.sources import records

LO, HI = -(2**63), 2**63 - 1


def ids(kind, n=20_000):
    rng = random.Random(kind)
    if kind == "outlier":
        return [*range(n), 2**60]
    if kind == "full range":
        return [LO, HI, -(2**62) - 5, 2**62 + 7, *(rng.randint(LO, HI) for _ in range(n))]
    if kind == "skewed":
        return list({int(10 ** rng.uniform(0, 18)) for _ in range(n)})
    return [(i // 7) << 40 for i in range(0, n)]


@pytest.mark.parametrize("kind", ["outlier", "full range", "skewed", "repeated"])
def test_position_of_any_ids(spark, kind):
    own = ids(kind)
    random.Random(1).shuffle(own)
    d = spark.createDataFrame([(x, i) for i, x in enumerate(own)], "id long, n int").repartition(7)
    got = [(r["index"], r["id"], r["n"]) for r in records.positional(d, ["id", "n"]).collect()]
    assert sorted(got) == [(i, *x) for i, x in enumerate(sorted((x, i) for i, x in enumerate(own)))]


@pytest.mark.parametrize("kind", ["outlier", "full range", "skewed"])
def test_buckets_are_even(spark, kind):
    d = spark.createDataFrame([(x,) for x in ids(kind, 60_000)], "id long").repartition(5)
    sizes = [r["count"] for r in prefix.number_bucketed(d, "id", "b").groupBy("b").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_number_of_buckets_is_bounded(spark):
    d = spark.range(50_000).select(F.expr("id * id * id").alias("id"))
    assert len(prefix.quantile_splits(d, "id", most=16)) <= 15
    sizes = [r["count"] for r in prefix.number_bucketed(d, "id", "b", prefix.quantile_splits(d, "id", most=16)).groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 50_000 / 16


def test_nulls_come_first_and_empty_tables_stay_empty(spark):
    d = spark.createDataFrame([(None, 1), (5, 2), (None, 3), (-4, 4)], "id long, n int")
    got = sorted((r["index"], r["n"]) for r in records.positional(d, ["id", "n"]).collect())
    assert got == [(0, 1), (1, 3), (2, 4), (3, 2)]
    assert records.positional(d.where("false"), ["id"]).count() == 0
    assert sorted(r["index"] for r in records.positional(d.where("id is null"), ["id", "n"]).collect()) == [0, 1]


def test_epoch_sampler_in_id_order(spark):
    own = [2**62, -(2**62), 0, 17, 2**61]
    d = spark.createDataFrame([(x,) for x in own], "id long")
    got = sorted((r["index"], r["id"], r["replica"]) for r in sequence.rank_sharded(d, "id", 1, 0, 2, shuffle=False).collect())
    wrapped = [*sorted(own), -(2**62)]
    assert got == [(i, x, i % 2) for i, x in enumerate(wrapped)]


def test_plan_has_no_task_for_all_rows(spark):
    """Rows meet by bucket; only the table of groups, 8 at most for 2,048 buckets, is in one partition."""
    d = spark.createDataFrame([(x,) for x in ids("skewed", 5000)], "id long")
    plan = records.positional(d, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3 and "CartesianProduct" not in plan
