"""Tree SHAP for the boosted-tree champion over the whole claims table (XAI-1, XAI-2).

Path-dependent Tree SHAP (Lundberg et al.) written leaf by leaf: for a leaf
whose path tests m distinct features, each with a row-independent cover
fraction z_j and a row-dependent "row follows the path" flag o_j,

    phi_i += v * (o_i - z_i) * sum_k k!(m-1-k)!/m! * e_k,

where e_k is the t^k coefficient of prod_{j != i} (z_j + o_j t). Everything
is vectorised over the rows of an Arrow batch; the per-leaf tables are
built once on the driver from the saved model (their size is bounded by
trees x 2^depth, not by the data) and shipped in the task closure.
Margins are on the log-odds scale (MLlib's GBT margin times 2).
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .model import TreeArrays, model_input, predict_proba


def leaf_paths(t: TreeArrays) -> tuple[list[tuple], float]:
    """Per leaf: (value, feats[m], z[m], conds[(pos, feat, thr, go_left)]); base value."""
    leaves: list[tuple] = []
    base = 0.0
    for root, w in zip(t.roots, t.weights):
        root_cover = t.cover[root]
        stack = [(root, [])]
        while stack:
            node, path = stack.pop()
            if t.feature[node] < 0:
                v = t.scale * w * t.value[node]
                base += v * t.cover[node] / root_cover
                feats: list[int] = []
                z: list[float] = []
                conds = []
                for (f, thr, go_left, ratio) in path:
                    if f not in feats:
                        feats.append(f)
                        z.append(1.0)
                    p = feats.index(f)
                    z[p] *= ratio
                    conds.append((p, f, thr, go_left))
                leaves.append((v, np.array(feats, dtype=np.int64), np.array(z), conds))
                continue
            f, thr = int(t.feature[node]), float(t.threshold[node])
            c = t.cover[node]
            lc, rc = t.left[node], t.right[node]
            stack.append((lc, path + [(f, thr, True, t.cover[lc] / c if c > 0 else 0.0)]))
            stack.append((rc, path + [(f, thr, False, t.cover[rc] / c if c > 0 else 0.0)]))
    return leaves, base


def _poly_weights(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """For rows of 0/1 flags o (r, m): sum_k w_k e_k for every feature i -> (r, m)."""
    r, m = o.shape
    wts = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.zeros((r, m))
    for i in range(m):
        coef = np.zeros((r, m))
        coef[:, 0] = 1.0
        for j in range(m):
            if j == i:
                continue
            new = coef * z[j]
            new[:, 1:] += coef[:, :-1] * o[:, j:j + 1]
            coef = new
        out[:, i] = coef @ wts
    return out


def leaf_tables(leaves: list[tuple]) -> list[tuple]:
    """Add to each leaf a (2^m, m) table of (o_i - z_i) * weights per flag pattern.

    o_j is 0/1, so a leaf's contribution depends only on which of its m <= depth
    features the row follows: at most 2^m patterns, computed once per leaf.
    """
    out = []
    for v, feats, z, conds in leaves:
        m = len(feats)
        if m == 0:
            continue
        pats = ((np.arange(2 ** m)[:, None] >> np.arange(m)[None, :]) & 1).astype(float)
        table = v * (pats - z[None, :]) * _poly_weights(z, pats)
        out.append((feats, conds, table, 1 << np.arange(m)))
    return out


#: Rows whose attributions and split outcomes are held at a time: they stay in a core's cache.
SLICE_ROWS = 2048


def _patterns(X: np.ndarray, tables: list[tuple]):
    """``(feats, table by feature, pattern per row)`` of every leaf; each split's outcome is computed once for all leaves."""
    cols = np.ascontiguousarray(X.T)
    held: dict[tuple, np.ndarray] = {}

    def follows(f, thr, go_left):
        key = (f, thr, go_left)
        if key not in held:
            held[key] = (cols[f] <= thr) if go_left else (cols[f] > thr)
        return held[key]

    for feats, conds, table, bits in tables:
        ok: list = [None] * len(feats)
        for p, f, thr, go_left in conds:
            now = follows(f, thr, go_left)
            ok[p] = now if ok[p] is None else ok[p] & now
        pattern = ok[0].astype(np.uint8 if len(feats) <= 8 else np.int64)
        for p in range(1, len(feats)):
            pattern |= ok[p].astype(pattern.dtype) << pattern.dtype.type(p)
        yield feats, table.T, pattern.astype(np.intp)


def shap_values(leaves: list[tuple], base: float, X: np.ndarray, tables: list[tuple] | None = None) -> np.ndarray:
    """(rows, n_features) attributions; rows of X are model inputs."""
    tables = tables if tables is not None else leaf_tables(leaves)
    out = np.empty(X.shape)
    for s in range(0, len(X), SLICE_ROWS):
        phi = np.zeros((X.shape[1], len(X[s:s + SLICE_ROWS])))
        for feats, by_feature, pattern in _patterns(X[s:s + SLICE_ROWS], tables):
            for f, values in zip(feats, by_feature):
                phi[f] += values[pattern]
        out[s:s + SLICE_ROWS] = phi.T
    return out


def tables_with(tables: list[tuple], feature: int) -> list[tuple]:
    """The leaves whose path tests ``feature``: no other leaf attributes anything to it."""
    return [t for t in tables if feature in t[0]]


def shap_of(feature: int, X: np.ndarray, tables: list[tuple]) -> np.ndarray:
    """Attributions of one feature; ``tables`` as ``tables_with`` gives them."""
    out = np.zeros(len(X))
    for s in range(0, len(X), SLICE_ROWS):
        for feats, by_feature, pattern in _patterns(X[s:s + SLICE_ROWS], tables):
            out[s:s + SLICE_ROWS] += by_feature[list(feats).index(feature)][pattern]
    return out


OUT_SCHEMA = ("claim_id string, bene_id string, base_value double, log_odds double, prediction_prob double, "
              + ", ".join(f"phi_{f} double" for f in K.FEATURE_COLS))


def tree_shap(features: DataFrame, t: TreeArrays) -> DataFrame:
    """Attributions for every claim, computed per Arrow batch on executors."""
    leaves, base = leaf_paths(t)
    tables = leaf_tables(leaves)
    xcols = [f"x_{c}" for c in K.FEATURE_COLS]

    def run(batches):
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            phi = shap_values(leaves, base, X, tables)
            lo = base + phi.sum(axis=1)
            out = pd.DataFrame(phi, columns=[f"phi_{f}" for f in K.FEATURE_COLS])
            out.insert(0, "prediction_prob", 1.0 / (1.0 + np.exp(-lo)))
            out.insert(0, "log_odds", lo)
            out.insert(0, "base_value", base)
            out.insert(0, "bene_id", pdf["bene_id"].to_numpy())
            out.insert(0, "claim_id", pdf["claim_id"].to_numpy())
            yield out

    return model_input(features, label=None).select("claim_id", "bene_id", *xcols).mapInPandas(run, OUT_SCHEMA)


WHATIF_SCHEMA = ("claim_id string, prob_original double, prob_corrected double, abs_change double, "
                 "rel_change double, shap_original double, shap_corrected double, shap_shift double, "
                 "action_original string, action_corrected string")


def what_if(features: DataFrame, t: TreeArrays, corrections: dict, focus: str = "prior_auth_present") -> DataFrame:
    """XAI-8 on the model: rescore with fields overwritten, in one pass per batch.

    Original and corrected rows are scored and attributed side by side, so the
    comparison needs no self-join. A score is the ensemble's margin, which the
    attributions of all features would add up to; only the focus is attributed.
    """
    pos = {f: i for i, f in enumerate(K.FEATURE_COLS)}
    fi = pos[focus]
    tables = tables_with(leaf_tables(leaf_paths(t)[0]), fi)
    xcols = [f"x_{c}" for c in K.FEATURE_COLS]

    def run(batches):
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            Xc = X.copy()
            for f, v in corrections.items():
                Xc[:, pos[f]] = float(v)
            phi0, phi1 = shap_of(fi, X, tables), shap_of(fi, Xc, tables)
            p0, p1 = predict_proba(t, X), predict_proba(t, Xc)
            yield pd.DataFrame({
                "claim_id": pdf["claim_id"].to_numpy(), "prob_original": p0, "prob_corrected": p1,
                "abs_change": p0 - p1, "rel_change": np.where(p0 > 0, (p0 - p1) / np.where(p0 > 0, p0, 1), np.nan),
                "shap_original": phi0, "shap_corrected": phi1, "shap_shift": phi1 - phi0,
                "action_original": np.where(p0 > K.DENY_THRESHOLD, "DENY", "APPROVE"),
                "action_corrected": np.where(p1 > K.DENY_THRESHOLD, "DENY", "APPROVE")})

    return model_input(features, label=None).select("claim_id", *xcols).mapInPandas(run, WHATIF_SCHEMA)


SCENARIO_SCHEMA = ("scenario string, ignored string, p0 double, p1 double, phi0 double, phi1 double")


def what_if_scenarios(features: DataFrame, t: TreeArrays, corrections: DataFrame,
                      focus: str = "prior_auth_present") -> DataFrame:
    """XAI-8 on the model over a corrections table: three legs in one row, in one pass per batch.

    A batch carries the claim's own values and those that the scenario may
    overwrite; the documented claim is scored once, on the driver.
    """
    from .whatif import changed, compare_legs, ignored_fields, with_scenarios
    pos = {f: i for i, f in enumerate(K.FEATURE_COLS)}
    fi = pos[focus]
    tables = tables_with(leaf_tables(leaf_paths(t)[0]), fi)
    keys = [c for c in ("sample_num", "claim_id") if c in features.columns]
    types = dict(features.dtypes)
    rows, fields = with_scenarios(features, corrections)
    sentinel = F.lit(K.MISSING_SENTINEL)
    new = {f"y_{f}": F.coalesce(changed(f, types[f]).cast("double"), sentinel) for f in fields}
    rows = model_input(rows.withColumns(new).withColumn("ignored", ignored_fields()), label=None,
                       carry=("sample_num", "scenario", "ignored", *new))
    xcols = [f"x_{c}" for c in K.FEATURE_COLS]

    def run(batches):
        for pdf in batches:
            X = pdf[xcols].to_numpy(dtype=float)
            Xc = X.copy()
            for f in fields:
                Xc[:, pos[f]] = pdf[f"y_{f}"].to_numpy(dtype=float)
            out = pdf[[*keys, "scenario", "ignored"]].copy()
            out["p0"], out["p1"] = predict_proba(t, X), predict_proba(t, Xc)
            out["phi0"], out["phi1"] = shap_of(fi, X, tables), shap_of(fi, Xc, tables)
            yield out

    documented = np.array([[K.MISSING_SENTINEL if K.DOCUMENTED_CLAIM[f] is None else float(K.DOCUMENTED_CLAIM[f])
                            for f in K.FEATURE_COLS]])
    baseline = float(predict_proba(t, documented)[0])
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [SCENARIO_SCHEMA])
    scored = rows.select(*keys, "scenario", "ignored", *xcols, *new).mapInPandas(run, schema)
    return compare_legs(scored, keys, baseline)
