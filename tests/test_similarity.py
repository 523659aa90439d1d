"""Similarities and losses of batches as block products, held against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import pooling

SCHEMA = "batch int, id long, view int, emb array<float>, i int, side int, id_ int"


def cosine(x, y):
    if x is None or y is None or None in x or None in y:
        return None
    nx, ny = math.sqrt(sum(v * v for v in x)), math.sqrt(sum(v * v for v in y))
    return sum(a * b for a, b in zip(x, y, strict=True)) / nx / ny if nx and ny else None


def batches(seed=3):
    """Batches of one side, of unequal sides, with null, zero and holed vectors, and one without a number."""
    rng = random.Random(seed)
    rows = []
    for batch, (n, m) in enumerate([(7, 7), (1, 1), (13, 4), (5, 0), (0, 3), (3, 3)]):
        rows += [(batch, i, 0, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(n)]
        rows += [(batch, i, 1, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(m)]
    rows += [(0, 50, 0, None), (0, 51, 1, [0.0, 0.0, 0.0]), (0, 51, 0, [1.0, None, 1.0]), (0, 52, 1, [1e-20, 0.0, 0.0]), (None, 1, 0, [1.0, 0.0, 0.0]), (None, 1, 1, [1.0, 0.0, 0.0])]
    rng.shuffle(rows)
    return [(*r, 1, 2, 3) for r in rows]


def paired(rows):
    return [(b, i, j, cosine(x, y)) for b, i, v, x, *_ in rows for c, j, w, y, *_ in rows if b is not None and b == c and (v, w) == (0, 1)]


@pytest.mark.parametrize("block", [2, 256])
def test_pairs_equal_loops(spark, monkeypatch, block):
    monkeypatch.setattr(pooling, "BLOCK", block)
    rows = batches()
    got = pooling.pairs_in_batch(spark.createDataFrame(rows, SCHEMA), "batch", "id", "view").collect()
    near = lambda found: sorted((b, i, j, None if s is None else round(s, 5)) for b, i, j, s in found)
    key = lambda r: (r[:3], r[3] is None)
    assert sorted(near(got), key=key) == sorted(near(paired(rows)), key=key)


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("temperature", [0.1, 0.001])
def test_batch_loss_equals_loops(spark, monkeypatch, block, temperature):
    monkeypatch.setattr(pooling, "BLOCK", block)
    rows = batches()
    got = {r.batch: r.loss for r in pooling.batch_contrastive_loss(spark.createDataFrame(rows, SCHEMA), "batch", "id", "view", temperature=temperature).collect()}
    found = [(b, i, j, s / temperature) for b, i, j, s in paired(rows) if s is not None]
    expected = {}
    for b in {p[0] for p in found}:
        sides = []
        for own in (1, 2):
            losses = []
            for k in {p[own] for p in found if p[0] == b}:
                z = [p for p in found if p[0] == b and p[own] == k]
                target = [p[3] for p in z if p[1] == p[2]]
                top = max(p[3] for p in z)
                losses += [top + math.log(sum(math.exp(p[3] - top) for p in z)) - x for x in target]
            sides.append(sum(losses) / len(losses))
        expected[b] = sum(sides) / 2
    assert got == pytest.approx(expected, rel=1e-4)


def test_batch_loss_equals_that_of_pairs(spark):
    d = spark.createDataFrame([r for r in batches(5) if r[0] is not None and r[3] is not None], SCHEMA)
    of_pairs = {r.batch: r.loss for r in pooling.contrastive_loss(pooling.pairs_in_batch(d, "batch", "id", "view").where("similarity is not null"), "batch").collect()}
    assert {r.batch: r.loss for r in pooling.batch_contrastive_loss(d, "batch", "id", "view").collect()} == pytest.approx(of_pairs)


def test_sizes_that_differ_are_an_error(spark):
    for one, other in (([1.0], [1.0, 2.0]), ([1.0, 2.0], [1.0])):
        d = spark.createDataFrame([(0, 1, 0, one), (0, 2, 0, [1.0]), (0, 1, 1, other)], "batch int, id int, view int, emb array<double>")
        with pytest.raises(Exception, match="vectors of sizes"):
            pooling.pairs_in_batch(d, "batch", "id", "view").collect()


def test_no_batches(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert pooling.pairs_in_batch(d, "batch", "id", "view").count() == 0
    assert pooling.batch_contrastive_loss(d, "batch", "id", "view").count() == 0


def test_each_side_is_dealt_out_once(spark):
    d = spark.range(100).select((F.col("id") % 7).alias("batch"), "id", (F.col("id") % 2).alias("view"), F.array(F.col("id").cast("double")).alias("emb"))
    plan = pooling.pairs_in_batch(d, "batch", "id", "view")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan
