"""Sinks append/overwrite as documented; DQ-3 input cleaning; audit requests."""
import tempfile

from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.operators import quality as DQ
from claimspark.plans.run import build_all


def test_build_all_and_append(spark, sf_small):
    out = tempfile.mkdtemp(prefix="claimspark-out-", dir="/tmp")
    p = build_all(spark, sf_small, out, with_models=False)
    n_audit = spark.read.parquet(p["audit_log"]).count()
    build_all(spark, sf_small, out, with_models=False)
    assert spark.read.parquet(p["audit_log"]).count() == n_audit > 0  # a rerun adds nothing
    feats = spark.read.parquet(p["claims_features"])
    assert len(feats.columns) == 42 and set(K.FEATURE_COLS) <= set(feats.columns)
    assert len(spark.read.parquet(p["claims_raw"]).columns) == 45
    assert spark.read.parquet(p["letters"]).count() == feats.count()


def test_clean_claim_input(spark):
    cols = ["primary_icd9_num", "drg_num", "utlztn_days", *K.CHRONIC_FEATURES, "chronic_count"]
    row = [0, 0, 5] + [1, 1] + [0] * (len(K.CHRONIC_FEATURES) - 2) + [9]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} int" for c in cols))
    r = DQ.clean_claim_input(df).first()
    assert (r.primary_icd9_num, r.drg_num, r.utlztn_days, r.chronic_count) == (None, None, 5, 2)


def test_override_rules(spark):
    df = spark.createDataFrame([("APPROVE", "valid reason"), ("HOLD", "valid reason"), ("DENY", "ok"),
                                ("DENY", None), (None, "long enough")], "final_decision string, override_reason string")
    got = [(r.is_valid, r.violations) for r in DQ.with_override_violations(df).collect()]
    assert got == [(True, ""), (False, "decision"), (False, "reason_too_short"), (False, "reason_too_short"),
                   (False, "decision")]


def test_claim_rules(spark):
    df = spark.createDataFrame([(1, 13, 130, -1), (0, 6, 70, 0), (None, None, None, None)],
                               "is_inpatient int, claim_month int, bene_age int, los_days int")
    for c in DQ.CLAIM_RULES:
        if c[0] not in df.columns:
            df = df.withColumn(c[0], F.lit(None).cast("int"))
    got = [(r.is_valid, r.violations) for r in DQ.with_claim_violations(df).collect()]
    assert got[0] == (False, "los_days_range,claim_month_range,bene_age_range")
    assert got[1] == (True, "") and got[2] == (True, "")


def test_optional_table(spark):
    from claimspark.sources.files import optional_table
    df = optional_table(spark, "/tmp/claimspark-does-not-exist-xyz", "feature string, mean_abs_shap double")
    assert df.count() == 0 and df.columns == ["feature", "mean_abs_shap"]


def test_model_side_tables(spark, sf_small):
    import __spark_entry__ as E
    q = E.queries()
    n = q["tree_shap"](spark, sf_small).count()
    assert q["tree_shap_drivers"](spark, sf_small).count() == 10 * n
    assert q["tree_shap_waterfall"](spark, sf_small).count() == 15 * n
    runs = q["champion_challenger"](spark, sf_small).collect()
    assert {r.metric for r in runs} >= {"test_auc_roc", "train_auc_roc"}
