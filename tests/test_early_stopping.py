"""Early stopping on AUC: every prefix scored in one pass, the model cut after the best."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.operators import model as MD
from claimspark.plans import pipeline as P


@pytest.mark.parametrize("history, patience, want", [
    ([0.5], 3, (0, False)), ([0.5, 0.6, 0.55, 0.6, 0.5], 3, (1, True)), ([0.5, 0.6, 0.55, 0.61, 0.5], 3, (3, False)),
    ([0.9, 0.1, 0.1, 0.95], 2, (0, True)), ([0.5, 0.5, 0.5], 2, (0, True))])
def test_best_round(history, patience, want):
    assert MD.best_round(history, patience) == want


def auc(y, p):
    order = np.argsort(p, kind="stable")
    _, at, n = np.unique(p[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - n + (n + 1) / 2)[at]
    pos = y[order] > 0.5
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def frame(spark, sf_small):
    return MD.training_frame(P.claims_features(spark, sf_small)).cache()


@pytest.fixture(scope="module")
def fitted(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    return {"champion": MD.fit_champion(frame, f"{path}/champion", max_iter=12), "challenger": MD.fit_challenger(frame, f"{path}/challenger", num_trees=12)}, path


@pytest.mark.parametrize("name", ["champion", "challenger"])
def test_prefix_auc_equals_the_cut_models(spark, frame, fitted, name):
    """The cut model's own probabilities give the recorded AUC, and are those of the ensemble's first trees."""
    models, path = fitted
    t = models[name]
    assert t.model.stages[-1].getNumTrees == t.best_iteration + 1 and len(t.history) == 12
    assert t.params["n_rows"] == str(frame.filter("split = 'train'").count())
    held_out = MD.model_input(frame.filter("split = 'test'"))
    pdf = t.model.transform(held_out).select("label", vector_to_array("probability")[1].alias("p"), *[f"x_{c}" for c in K.FEATURE_COLS]).toPandas()
    assert auc(pdf["label"].to_numpy(), pdf["p"].to_numpy()) == pytest.approx(t.history[t.best_iteration], abs=2e-4)
    whole = MD.PipelineModel.load(f"{path}/{name}")
    trees = MD.tree_arrays(spark, f"{path}/{name}", whole)
    prefixes = MD.prefix_scores(trees, pdf[[f"x_{c}" for c in K.FEATURE_COLS]].to_numpy(dtype=float))
    assert prefixes.shape[1] == 12
    np.testing.assert_allclose(prefixes[:, t.best_iteration], pdf["p"], atol=1e-9)


def test_rounds_double_until_nothing_improves(spark, frame, tmp_path):
    """Training goes on where the best round is among the last, and gives what one long fit gives."""
    train = MD._spread(MD.model_input(frame.filter("split = 'train'").withColumn("weight", F.lit(1.0))), 1000)
    held_out = MD.model_input(frame.filter("split = 'test'"))
    asked = []

    def fit(n):
        asked.append(n)
        return MD.champion(max_iter=n, maxDepth=3)

    model, best, history = MD.early_stopped(fit, train, held_out, str(tmp_path / "a"), most=12, patience=4, first=3)
    assert asked == sorted(set(asked)) and asked[0] == 3 and asked[-1] <= 12
    _, same, long = MD.early_stopped(lambda n: MD.champion(max_iter=n, maxDepth=3), train, held_out, str(tmp_path / "b"), most=12, patience=4, first=12)
    assert best == same and history == pytest.approx(long[:len(history)]) and model.stages[-1].getNumTrees == best + 1


def test_partitions_do_not_matter(spark, frame, tmp_path):
    a, b = (MD.fit_champion(frame.repartition(n), str(tmp_path / str(n)), max_iter=5) for n in (2, 8))
    assert a.history == b.history and a.best_iteration == b.best_iteration


def test_one_class_has_no_best(spark, frame, tmp_path):
    rows = MD.model_input(frame.filter("split = 'train'").withColumn("weight", F.lit(1.0)))
    trees_of = MD.early_stopped(lambda n: MD.champion(max_iter=n, maxDepth=2), rows, rows.filter("label = 1"), str(tmp_path / "c"), most=3, patience=2)
    assert trees_of[1] == 0 and trees_of[2] == [0.5, 0.5, 0.5]


def test_saved_model_loads(spark, fitted, frame, tmp_path):
    models, _ = fitted
    MD.save(models["champion"], str(tmp_path / "saved"))
    model, cols = MD.load(spark, str(tmp_path / "saved"))
    assert cols == list(K.FEATURE_COLS)
    a, b = (MD.score(m, frame).agg(F.sum("prediction_prob"), F.count("*")).first() for m in (model, models["champion"].model))
    assert a[0] == pytest.approx(b[0]) and a[1] == b[1]


def test_training_partitions_are_large(spark):
    """A level of a tree is a job over all partitions: few large ones, in number by the data alone."""
    rows = spark.range(250).select(F.col("id").cast("string").alias("claim_id"))
    assert [MD._spread(rows, n).rdd.getNumPartitions() for n in (1, 100_000, 100_001, 7_200_000)] == [1, 1, 2, 72]
