"""Tree SHAP: exact against brute-force path-dependent Shapley on a hand-built ensemble."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest

from claimspark.operators.model import TreeArrays, predict_margin
from claimspark.operators.treeshap import SLICE_ROWS, leaf_paths, leaf_tables, shap_of, shap_values, tables_with


def small_ensemble() -> TreeArrays:
    # tree 0: f0<=0.5 ? (f1<=1 ? 1.0 : -0.5) : 2.0 ; tree 1: f2<=0 ? 0.3 : (f0<=0.5 ? -1.0 : 0.7)
    feature = np.array([0, 1, -1, -1, -1, 2, -1, 0, -1, -1])
    threshold = np.array([0.5, 1.0, 0, 0, 0, 0.0, 0, 0.5, 0, 0])
    left = np.array([1, 2, -1, -1, -1, 6, -1, 8, -1, -1])
    right = np.array([4, 3, -1, -1, -1, 7, -1, 9, -1, -1])
    value = np.array([0, 0, 1.0, -0.5, 2.0, 0, 0.3, 0, -1.0, 0.7])
    cover = np.array([100, 60, 20, 40, 40, 100, 30, 70, 25, 45], dtype=float)
    return TreeArrays(feature, threshold, left, right, value, cover, np.array([0, 5]), np.array([1.0, 0.5]), 2.0)


def expected(t: TreeArrays, x, S, node):
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    l, r = t.left[node], t.right[node]
    if f in S:
        return expected(t, x, S, l if x[f] <= t.threshold[node] else r)
    c = t.cover[node]
    return (t.cover[l] * expected(t, x, S, l) + t.cover[r] * expected(t, x, S, r)) / c


def brute(t: TreeArrays, x, n=3):
    def v(S):
        return t.scale * sum(w * expected(t, x, set(S), root) for root, w in zip(t.roots, t.weights))
    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for S in combinations(others, k):
                wt = factorial(k) * factorial(n - k - 1) / factorial(n)
                phi[i] += wt * (v(S + (i,)) - v(S))
    return phi, v(())


@pytest.mark.parametrize("x", [[0.0, 0.5, -1.0], [1.0, 2.0, 1.0], [0.2, 3.0, 0.5], [0.9, 0.0, -2.0]])
def test_matches_brute_force(x):
    t = small_ensemble()
    leaves, base = leaf_paths(t)
    X = np.array([x])
    phi = shap_values(leaves, base, X)[0]
    want, want_base = brute(t, x)
    assert base == pytest.approx(want_base, abs=1e-12)
    assert np.allclose(phi, want, atol=1e-12)
    assert base + phi.sum() == pytest.approx(2 * predict_margin(t, X)[0], abs=1e-12)


def test_trained_model_additivity(spark, sf_small):
    from pyspark.sql import functions as F
    from claimspark.plans import models as M
    ts = M.tree_shap(spark, sf_small)
    scored = M.gbt_score(spark, sf_small).select("claim_id", F.col("prediction_prob").alias("p_model"))
    d = ts.join(scored, "claim_id").select(F.max(F.abs(F.col("prediction_prob") - F.col("p_model")))).first()[0]
    assert d < 1e-9


def test_model_what_if_consistent(spark, sf_small):
    from pyspark.sql import functions as F
    from claimspark.plans import models as M
    import __spark_entry__ as E
    wi = E.queries()["model_what_if"](spark, sf_small)
    scored = M.gbt_score(spark, sf_small).select("claim_id", F.col("prediction_prob").alias("p"))
    d = wi.join(scored, "claim_id").select(F.max(F.abs(F.col("prob_original") - F.col("p")))).first()[0]
    assert d < 1e-9
    r = wi.agg(F.max(F.abs(F.col("abs_change") - (F.col("prob_original") - F.col("prob_corrected"))))).first()[0]
    assert r < 1e-12


def test_one_feature_alone_and_slices():
    """A what-if attributes its focus from the leaves that test it; rows are worked off in slices."""
    t = small_ensemble()
    leaves, base = leaf_paths(t)
    X = np.random.default_rng(2).normal(size=(SLICE_ROWS + 3, 3))
    phi = shap_values(leaves, base, X)
    for i in (0, 1, 17, SLICE_ROWS - 1, SLICE_ROWS, SLICE_ROWS + 2):
        assert np.allclose(phi[i], brute(t, X[i])[0], atol=1e-12)
    tables = leaf_tables(leaves)
    assert [len(tables_with(tables, f)) for f in range(3)] == [5, 2, 3] and len(tables) == 6
    for f in range(3):
        assert np.array_equal(shap_of(f, X, tables_with(tables, f)), phi[:, f])
    assert np.allclose(base + phi.sum(1), 2 * predict_margin(t, X), atol=1e-12)
