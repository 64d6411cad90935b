"""AUC / AP from the distributed prefix-sum plan equal brute-force definitions."""
import numpy as np
import pytest

from claimspark.operators import metrics as ME


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])


def brute_ap(s, y):
    ap, prev_r = 0.0, 0.0
    P = y.sum()
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        prec, rec = tp / sel.sum(), tp / P
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


def test_auc_ap(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(400), 2)  # many ties
    y = (rng.random(400) < s).astype(int)
    g = np.where(rng.random(400) < 0.3, "test", "train")
    df = spark.createDataFrame([(str(a), float(b), int(c)) for a, b, c in zip(g, s, y)],
                               "split string, score double, denial_label int")
    counts = ME.score_counts(df, "split", "score", "denial_label")
    small = ME.prefix_counts(counts, "split", n_buckets=4).collect()
    assert len(small) == counts.count()
    got = {r.split: (r.auc_roc, r.avg_precision) for r in ME.roc_auc_ap(df).collect()}
    for name in ("train", "test"):
        m = g == name
        assert got[name][0] == pytest.approx(round(brute_auc(s[m], y[m]), 4), abs=1e-4)
        assert got[name][1] == pytest.approx(round(brute_ap(s[m], y[m]), 4), abs=1e-4)


def test_confusion_f1(spark):
    df = spark.createDataFrame([("t", 0.9, 1), ("t", 0.6, 0), ("t", 0.2, 1), ("t", 0.5, 1), ("t", 0.1, 0)],
                               "split string, score double, denial_label int")
    c = ME.confusion(df).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 1, 1)
    f = ME.f1_precision_recall(ME.confusion(df)).first()
    assert (f.precision, f.recall, f.f1) == (0.6667, 0.6667, 0.6667)


def test_ranges_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 11 == 0 else "ab"[k % 2], float(round(s, 2)), int(k % 3 == 0)) for k, s in enumerate(rng.random(500))]
    counts = ME.score_counts(spark.createDataFrame(rows, "split string, score double, denial_label int"), "split", "score", "denial_label")

    def found(**kw):
        return sorted(map(tuple, ME.prefix_counts(counts, "split", **kw).collect()), key=repr)

    want = []
    for g in {r[0] for r in rows}:
        of = [(s, y) for h, s, y in rows if h == g]
        for s in {s for s, _ in of}:
            here = [y for t, y in of if t == s]
            below = [y for t, y in of if t < s]
            want.append((g, s, sum(here), len(here) - sum(here), sum(below), len(below) - sum(below)))
    assert found(n_buckets=1) == found(n_buckets=7) == found(rows_per_range=10) == sorted(want, key=repr)
    assert ME.prefix_counts(counts.limit(0), "split").count() == 0
