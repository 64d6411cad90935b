"""Golden scorecard values for the reference presets and attribution properties."""
import math

import pytest
from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.functions.mathx import logit
from claimspark.operators import label, shap
from claimspark.operators.survey import literature_rates

PRESET_COLS = ["is_inpatient", "los_days", "clm_pmt_amt", "prior_auth_present", "primary_icd9_num",
               "chronic_count", "bene_hi_mons", "bene_hmo_mons"]
PRESETS = {  # name: values in PRESET_COLS order; expected (log-odds, probability)
    "missing_prior_auth": ((0, 0, 150.0, 0, 250, 4, 12, 0), (-0.981152, 0.272663)),
    "corrected": ((0, 0, 150.0, 1, 250, 4, 12, 0), (-1.781152, 0.144161)),
    "documented_baseline": ((0, 0, 80.0, 1, 401, 2, 12, 0), (-1.811152, 0.140499)),
    "high_cost_inpatient": ((1, 7, 12000.0, 0, 410, 6, 12, 0), (-0.751152, 0.320570)),
}
SCHEMA = ("name string, is_inpatient int, los_days int, clm_pmt_amt double, prior_auth_present int, "
          "primary_icd9_num int, chronic_count int, bene_hi_mons int, bene_hmo_mons int")


def test_literature_intercept(spark):
    rates = literature_rates(spark)
    assert rates.count() == 12
    assert label.intercept_of(rates) == pytest.approx(-1.7411520, abs=1e-6)
    assert logit(0.1491667) == pytest.approx(-1.7411520, abs=1e-6)


def test_presets(spark):
    ic = label.intercept_of(literature_rates(spark))
    df = spark.createDataFrame([(n, *v) for n, (v, _) in PRESETS.items()], SCHEMA)
    got = {r.name: (r.log_odds, r.denial_prob) for r in label.with_scorecard(df, ic).collect()}
    for name, (_, (lo, p)) in PRESETS.items():
        assert got[name][0] == pytest.approx(lo, abs=1e-6), name
        assert got[name][1] == pytest.approx(p, abs=1e-6), name
    # direction: adding prior authorisation lowers the score
    assert got["corrected"][1] < got["missing_prior_auth"][1]


def _features(spark):
    from claimspark.plans import pipeline as P
    return P


def test_scorecard_shap_additive(spark, sf_small):
    from claimspark.plans import pipeline as P
    s = P.scorecard_shap(spark, sf_small)
    lo = label.scorecard_log_odds(P.intercept(spark, sf_small))
    worst = s.select(F.max(F.abs(F.col("log_odds") - lo)).alias("d")).first().d
    assert worst < 1e-9
    # background mean of attributions is zero for every feature
    means = s.agg(*[F.avg(f"phi_{f}").alias(f) for f in K.FEATURE_COLS]).first().asDict()
    assert max(abs(v) for v in means.values()) < 1e-9


def test_top_drivers_order(spark, sf_small):
    from claimspark.plans import pipeline as P
    rows = shap.top_drivers(P.scorecard_shap(spark, sf_small), k=36).limit(36 * 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.claim_id, []).append(r)
    for cid, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        vals = [abs(r.shap_value) for r in rs]
        assert all(a >= b - 1e-6 for a, b in zip(vals, vals[1:])), cid


def test_label_rate_matches_probability(spark, sf_small):
    from claimspark.plans import pipeline as P
    r = P.claims_features(spark, sf_small).agg(F.avg("denial_label").alias("l"), F.avg("denial_prob").alias("p"),
                                              F.count(F.lit(1)).alias("n")).first()
    # Bernoulli draw: realised rate within 4 standard errors of the mean probability
    assert abs(r.l - r.p) < 4 * math.sqrt(0.25 / r.n)
