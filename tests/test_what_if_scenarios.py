"""Corrections tables: scenarios for every claim, corrections by claim, odd tables."""
import pytest
from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.operators import treeshap as TS
from claimspark.operators import whatif as WI
from claimspark.plans import models as M
from claimspark.plans import pipeline as P

TABLE = "scenario string, changes map<string,double>"


@pytest.fixture(scope="module")
def parts(spark, sf_small):
    return P.claims_features(spark, sf_small), P.intercept(spark, sf_small), P.background_means(spark, sf_small)


def test_scenario_equals_single_correction(spark, parts):
    f, ic, means = parts
    table = spark.createDataFrame([("fix", {k: float(v) for k, v in WI.PRIOR_AUTH_FIX.items()}), ("none", {}), ("null", None)], TABLE)
    got = WI.what_if_scenarios(f, table, ic, means)
    assert got.count() == 3 * f.count()
    old = WI.what_if(f, ic, means, WI.PRIOR_AUTH_FIX)
    assert got.filter("scenario = 'fix'").select(old.columns).exceptAll(old).count() == 0
    assert got.filter("scenario <> 'fix' AND (abs_change <> 0 OR shap_shift <> 0)").count() == 0
    assert {r[0] for r in got.select("prob_baseline").distinct().collect()} == {round(WI.baseline_probability(spark, ic), 6)}


def test_corrections_by_claim(spark, parts):
    f, ic, means = parts
    ids = [r.claim_id for r in f.select("claim_id").orderBy("claim_id").limit(3).collect()]
    table = spark.createDataFrame([(ids[0], "a", {"prior_auth_present": 1.0, "colour": 3.0}), (ids[0], "b", {"primary_icd9_num": None}),
                                   (ids[1], "a", {}), ("no such claim", "a", {}), (None, "a", {})], "claim_id string, " + TABLE)
    got = {(r.claim_id, r.scenario): r for r in WI.what_if_scenarios(f, table, ic, means).collect()}
    assert set(got) == {(ids[0], "a"), (ids[0], "b"), (ids[1], "a")}
    assert got[ids[0], "a"].ignored == "colour" and got[ids[1], "a"].ignored == ""
    emptied = f.filter(F.col("claim_id") == ids[0]).withColumn("primary_icd9_num", F.lit(None).cast("int"))
    alone = WI.what_if_scenarios(emptied, spark.createDataFrame([("x", {})], TABLE), ic, means).first()
    assert got[ids[0], "b"].prob_corrected == alone.prob_corrected


def test_odd_tables(spark, parts):
    f, ic, means = parts
    assert WI.what_if_scenarios(f, spark.createDataFrame([], TABLE), ic, means).count() == 0
    assert WI.what_if_scenarios(f.limit(0), spark.createDataFrame([("x", {})], TABLE), ic, means).count() == 0
    many = spark.createDataFrame([(str(k), {}) for k in range(WI.MAX_SCENARIOS + 1)], TABLE)
    with pytest.raises(ValueError, match="at most"):
        WI.what_if_scenarios(f, many, ic, means)


def test_plan_has_no_join(spark, parts):
    f, ic, means = parts
    plan = WI.what_if_scenarios(f, spark.createDataFrame(K.WHAT_IF_SCENARIOS, TABLE), ic, means)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_model_scenarios_equal_single_correction(spark, sf_small, parts):
    f = parts[0]
    trees = M.tree_arrays(spark, sf_small)
    table = spark.createDataFrame([("fix", {k: float(v) for k, v in WI.PRIOR_AUTH_FIX.items()}), ("gone", {"drg_num": None})], TABLE)
    got = TS.what_if_scenarios(f, trees, table)
    assert got.count() == 2 * f.count()
    old = TS.what_if(f, trees, WI.PRIOR_AUTH_FIX).select("claim_id", F.col("prob_corrected").alias("p"), F.col("shap_shift").alias("s"))
    far = got.filter("scenario = 'fix'").join(old, "claim_id").filter("abs(prob_corrected - p) > 1e-6 OR abs(shap_shift - s) > 2e-6")
    assert far.count() == 0
