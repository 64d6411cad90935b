"""Boosted trees grown in steps are MLlib's, and no round is trained twice."""

import platform

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.operators import boosting as BO
from claimspark.operators import model as MD

X = [f"x_{c}" for c in K.FEATURE_COLS]


def rows(spark, n, parts=1):
    """Training rows with flags, few-valued, continuous, missing and constant features, and two weights."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (n, len(X))).astype(float)
    x[:, 1], x[:, 2], x[:, 3], x[:, 4] = rng.normal(size=n), rng.integers(0, 60, n), np.where(rng.random(n) < 0.2, -9999.0, rng.random(n)), 5.0
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 1] + x[:, 5] - x[:, 6])))).astype(float)
    out = spark.createDataFrame([(i, float(y[i]), 1.7 if y[i] else 1.0, *map(float, x[i])) for i in range(n)], ["i", "label", "weight", *X])
    return out.repartition(parts, "i").sortWithinPartitions("i").drop("i").cache()


def table(model, path, spark):
    model.write().overwrite().save(path)
    trees = sorted((r["_1"], r["_3"]) for r in spark.read.parquet(f"{path}/treesMetadata").collect())
    return sorted(spark.read.parquet(f"{path}/data").collect(), key=lambda r: (r.treeID, r.nodeData.id)), trees


@pytest.mark.parametrize("parts", [1, 3])
def test_trees_are_those_of_mllib(spark, tmp_path, parts):
    data, est = rows(spark, 3000, parts), MD.champion(max_iter=8, maxDepth=5, cacheNodeIds=False)
    want = Pipeline(stages=[MD.assembler(), est]).fit(data).stages[-1]
    growth = BO.Growth(data, est, X, MD.assembler())
    for n in (3, 8):  # in two steps
        growth.grow(n)
    got = growth.model(est, str(tmp_path / "grown"))
    growth.close()
    (a, trees), (b, same) = table(want, str(tmp_path / "a"), spark), table(got, str(tmp_path / "b"), spark)
    assert trees == same and len(a) == len(b)
    if parts == 1 and platform.machine() == "x86_64":  # sums of several partitions are MLlib's but for their order
        assert a == b
    assert [(r.treeID, r.nodeData.id, r.nodeData.split) for r in a][:20] == [(r.treeID, r.nodeData.id, r.nodeData.split) for r in b][:20]
    assert got.getNumTrees == 8 and got.numFeatures == len(X) and got.getMaxIter() == 8 and got.totalNumNodes == want.totalNumNodes
    np.testing.assert_allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-6)


def test_no_round_is_trained_twice(spark, tmp_path, monkeypatch):
    """Doubled rounds go on from those before; nothing is fitted again."""
    data, grown = rows(spark, 600), []
    one = BO.Growth._round
    monkeypatch.setattr(BO.Growth, "_round", lambda self: (grown.append(len(self.trees)), one(self)))
    monkeypatch.setattr(MD.Pipeline, "fit", lambda *a: pytest.fail("fitted from the start"))
    model, best, history = MD.early_stopped(lambda n: MD.champion(max_iter=n, maxDepth=2), data, data, str(tmp_path / "m"), most=12, patience=20, first=3)
    assert grown == list(range(12)) and len(history) == 12 and model.stages[-1].getNumTrees == best + 1


def test_sums_of_many_partitions(spark, monkeypatch):
    """Where tasks add up partitions first, the sum is the same but for rounding."""
    arrays = {k: np.random.default_rng(k).normal(size=(4, 10)) for k in range(11)}
    parts = spark.sparkContext.parallelize(list(arrays.items()), 11)
    want = BO._summed(parts, 11)
    monkeypatch.setattr(BO, "DIRECT_PARTS", 4)
    np.testing.assert_allclose(BO._summed(parts, 11), want, atol=1e-12)
    np.testing.assert_allclose(sum(arrays.values()), want, atol=1e-12)


def test_random_numbers_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    for seed in (42, -7, 2 ** 40):
        r = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert [r.nextDouble() for _ in range(400)] == list(BO.uniforms(seed, 400))
        r, mine = jvm.java.util.Random(seed), BO.JavaRandom(seed)
        assert [r.nextLong() & BO._M64 for _ in range(5)] == [mine.next_long() for _ in range(5)]
    assert len(BO.uniforms(1, 0)) == 0 and BO.reservoir(3, 5, 1) == [0, 1, 2]


def test_exponential_is_that_of_the_jvm(spark):
    x = np.random.default_rng(1).uniform(-9, 9, 500)
    got = BO.jvm_exp(x)
    np.testing.assert_allclose(got, np.exp(x), rtol=3e-16)
    if platform.machine() == "x86_64":
        assert list(got) == [spark._jvm.java.lang.Math.exp(float(v)) for v in x]
    np.testing.assert_array_equal(BO.jvm_exp(np.array([-800.0, 0.0])), [0.0, 1.0])


def test_one_class_and_repeated_rows(spark, tmp_path):
    """Pure nodes are leaves: a label without variance gives trees of one node."""
    data = rows(spark, 40).withColumn("label", F.lit(1.0)).withColumn("weight", F.lit(1.0))
    data, est = data.unionAll(data).cache(), MD.champion(max_iter=3, cacheNodeIds=False)
    want = Pipeline(stages=[MD.assembler(), est]).fit(data).stages[-1]
    growth = BO.Growth(data, est, X, MD.assembler())
    growth.grow(3)
    got = growth.model(est, str(tmp_path / "grown"))
    assert table(want, str(tmp_path / "a"), spark)[0] == table(got, str(tmp_path / "b"), spark)[0]
