"""Registered queries: name -> (Spark builder, DuckDB oracle text or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
driver tables. Oracle texts run in DuckDB over the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle as O
from . import pipeline as P
from ..operators import label

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- slice 1: the flagship -------------------------------------------------

@register("denial_rate_by_prior_auth", O.with_ctes(["f"], """
SELECT claim_type, prior_auth_present, COUNT(*) AS n_claims, SUM(denial_label) AS n_denied,
       ROUND(AVG(CAST(denial_label AS DOUBLE)), 6) AS denial_rate, ROUND(AVG(denial_prob), 6) AS mean_prob
FROM f GROUP BY claim_type, prior_auth_present"""))
def q_denial_rate_by_prior_auth(spark, sf_dir):
    return label.denial_rate_by_prior_auth(P.claims_features(spark, sf_dir))


# --- slice 2: raw cleaning ---------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from .. import constants as K  # noqa: E402
from ..functions.cleaning import icd9_prefix  # noqa: E402
from ..operators import audit as AU  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import ingest as IN  # noqa: E402
from ..operators import metrics as ME  # noqa: E402
from ..operators import quality as DQ  # noqa: E402
from ..operators import sampling as SM  # noqa: E402
from ..operators import shap as SH  # noqa: E402
from ..operators import whatif as WI  # noqa: E402
from ..sources import fixtures as FX  # noqa: E402


def _sel(cols: list[str]) -> str:
    return ", ".join(cols)


@register("claim_type_counts", O.with_ctes(["cr"], "SELECT claim_type, COUNT(*) AS n FROM cr GROUP BY claim_type"))
def q_claim_type_counts(spark, sf_dir):
    return P.claims_raw(spark, sf_dir).groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


_DATES = ["claim_id", "claim_type", "CLM_FROM_DT", "CLM_THRU_DT"]


@register("clean_dates", O.with_ctes(["cc"], f"SELECT {_sel(_DATES)} FROM cc"))
def q_clean_dates(spark, sf_dir):
    return P.clean_claims(spark, sf_dir).select(*_DATES)


_NPI = ["claim_id", "AT_PHYSN_NPI", "OP_PHYSN_NPI"]


@register("clean_npi", O.with_ctes(["cc"], f"SELECT {_sel(_NPI)} FROM cc"))
def q_clean_npi(spark, sf_dir):
    return P.clean_claims(spark, sf_dir).select(*_NPI)


def _kind_frame(spark, sf_dir, kind: str):
    raw = FX.raw_claims(spark, sf_dir).filter(F.col("claim_type") == kind).drop("claim_type")
    wanted = K.IP_COLS if kind == "IP" else K.OP_COLS
    return raw.select(*[c for c in wanted if c in raw.columns])


@register("segment_filter", O.with_ctes(["cc"], "SELECT claim_id FROM cc WHERE claim_type = 'IP'"))
def q_segment_filter(spark, sf_dir):
    return IN.clean_claims(_kind_frame(spark, sf_dir, "IP"), kind="IP").select("claim_id")


_UNION = ["claim_id", "claim_type", "HCPCS_CD_1", "CLM_DRG_CD", "ADMTNG_ICD9_DGNS_CD", "CLM_UTLZTN_DAY_CNT"]


@register("union_ip_op", O.with_ctes(["cc"], f"SELECT {_sel(_UNION)} FROM cc"))
def q_union_ip_op(spark, sf_dir):
    ip = IN.clean_claims(_kind_frame(spark, sf_dir, "IP"), kind="IP")
    op = IN.clean_claims(_kind_frame(spark, sf_dir, "OP"), kind="OP")
    return IN.union_claims([ip, op]).select(*_UNION)


@register("claims_bene_left_join", O.with_ctes(["cr"], "SELECT * FROM cr"))
def q_claims_bene_left_join(spark, sf_dir):
    return P.claims_raw(spark, sf_dir)


# --- slice 3: features -------------------------------------------------------
_FEAT_SETS = {
    "feat_temporal": (FE.feat_temporal, ["los_days", "claim_year", "claim_month"]),
    "feat_amounts": (FE.feat_amounts, ["clm_pmt_amt", "primary_payer_amt", "has_primary_payer", "is_adjustment"]),
    "feat_provider": (FE.feat_provider, ["prior_auth_present", "has_op_surgeon"]),
    "feat_diagnosis": (FE.feat_diagnosis, ["primary_icd9_num", "num_diagnoses", "num_procedures", "has_procedure",
                                           "has_hcpcs", "drg_num", "utlztn_days"]),
    "feat_demographics": (FE.feat_demographics, ["bene_age", "bene_sex", "bene_race", "bene_esrd", "bene_hi_mons",
                                                 "bene_hmo_mons", "bene_is_deceased"]),
    "feat_chronic": (FE.feat_chronic, [*K.CHRONIC_FEATURES, "chronic_count"]),
}


def _feat_query(stage, cols):
    def q(spark, sf_dir):
        return stage(P.claims_raw(spark, sf_dir)).select("claim_id", *cols)
    return q


for _name, (_stage, _cols) in _FEAT_SETS.items():
    register(_name, O.with_ctes(["f0"], f"SELECT claim_id, {_sel(_cols)} FROM f0"))(_feat_query(_stage, _cols))

_FT_COLS = [*K.ID_COLS, *K.FEATURE_COLS]


@register("feature_table", O.with_ctes(["f"], f"SELECT {_sel(_FT_COLS)}, ROUND(denial_prob, 6) AS denial_prob, "
                                              "denial_label FROM f"))
def q_feature_table(spark, sf_dir):
    return P.claims_features(spark, sf_dir).select(*_FT_COLS, F.round("denial_prob", 6).alias("denial_prob"),
                                                   "denial_label")


_ICD_SRC = ["ADMTNG_ICD9_DGNS_CD", "ICD9_DGNS_CD_1", "ICD9_DGNS_CD_2", "ICD9_DGNS_CD_3"]
_ICD_OUT = ["adm_prefix", "dx1_prefix", "dx2_prefix", "dx3_prefix"]


@register("icd9_prefix_strict", O.with_ctes(["cc"], "SELECT claim_id, " + ", ".join(
    f"{c}, {O.icd(c)} AS {o}" for c, o in zip(_ICD_SRC, _ICD_OUT)) + " FROM cc"))
def q_icd9_prefix_strict(spark, sf_dir):
    cc = P.clean_claims(spark, sf_dir)
    return cc.select("claim_id", *[x for c, o in zip(_ICD_SRC, _ICD_OUT) for x in (F.col(c), icd9_prefix(c).alias(o))])


@register("icd9_prefix_normalised", O.with_ctes(["raw_claims"], "SELECT CLM_ID AS claim_id, " + ", ".join(
    f"{O.icd(c, normalise=True)} AS {o}" for c, o in zip(_ICD_SRC, _ICD_OUT)) + " FROM raw_claims"))
def q_icd9_prefix_normalised(spark, sf_dir):
    raw = FX.raw_claims(spark, sf_dir)
    return raw.select(F.col("CLM_ID").alias("claim_id"),
                      *[icd9_prefix(c, normalise=True).alias(o) for c, o in zip(_ICD_SRC, _ICD_OUT)])


# --- slice 4: survey rates and label -----------------------------------------

@register("survey_rates", O.with_ctes(["sr"], "SELECT age_group, insurance_type, ROUND(denial_rate, 6) AS "
                                              "denial_rate, n, source FROM sr"))
def q_survey_rates(spark, sf_dir):
    return P.survey_rates(spark, sf_dir).withColumn("denial_rate", F.round("denial_rate", 6))


@register("base_rate_intercept", O.with_ctes(["ic"], "SELECT ROUND(base_rate, 9) AS base_rate, "
                                                     "ROUND(intercept, 9) AS intercept FROM ic"))
def q_base_rate_intercept(spark, sf_dir):
    return label.base_rate(P.survey_rates(spark, sf_dir)).select(F.round("base_rate", 9).alias("base_rate"),
                                                                 F.round("intercept", 9).alias("intercept"))


@register("scorecard_prob", O.with_ctes(["f", "fl"], "SELECT fl.claim_id, ROUND(fl.log_odds, 6) AS log_odds, "
                                                     "ROUND(f.denial_prob, 6) AS denial_prob FROM fl JOIN f "
                                                     "ON fl.claim_id = f.claim_id"))
def q_scorecard_prob(spark, sf_dir):
    s = label.with_scorecard(P.features_unlabelled(spark, sf_dir), P.intercept(spark, sf_dir))
    return s.select("claim_id", F.round("log_odds", 6).alias("log_odds"), F.round("denial_prob", 6).alias("denial_prob"))


@register("denial_label", O.with_ctes(["f"], "SELECT claim_id, denial_label FROM f"))
def q_denial_label(spark, sf_dir):
    return P.claims_features(spark, sf_dir).select("claim_id", "denial_label")


@register("label_summary", O.with_ctes(["f"], """
SELECT COUNT(*) AS n_claims, ROUND(AVG(CAST(denial_label AS DOUBLE)), 6) AS denial_rate, SUM(denial_label) AS n_denied,
 SUM(CASE WHEN denial_label = 0 THEN 1 ELSE 0 END) AS n_approved,
 SUM(CASE WHEN prior_auth_present = 0 THEN 1 ELSE 0 END) AS n_no_auth,
 ROUND(AVG(CASE WHEN prior_auth_present = 0 THEN CAST(denial_label AS DOUBLE) END), 6) AS denial_rate_no_auth,
 SUM(CASE WHEN prior_auth_present = 1 THEN 1 ELSE 0 END) AS n_with_auth,
 ROUND(AVG(CASE WHEN prior_auth_present = 1 THEN CAST(denial_label AS DOUBLE) END), 6) AS denial_rate_with_auth
FROM f"""))
def q_label_summary(spark, sf_dir):
    s = label.label_summary(P.claims_features(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith("denial_rate") else F.col(c).cast("long").alias(c)
                      for c in s.columns])


# --- slice 3b: data quality -----------------------------------------------------
def _viol_sql() -> str:
    parts = []
    for c, lo, hi in DQ.CLAIM_RULES:
        cond = []
        if lo is not None:
            cond.append(f"{c} < {lo}")
        if hi is not None:
            cond.append(f"{c} > {hi}")
        parts.append(f"CASE WHEN {c} IS NOT NULL AND ({' OR '.join(cond)}) THEN '{c}_range' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


@register("validate_claims", O.with_ctes(["f"], f"SELECT claim_id, v = '' AS is_valid, v AS violations FROM "
                                                f"(SELECT claim_id, {_viol_sql()} AS v FROM f) t"))
def q_validate_claims(spark, sf_dir):
    return DQ.with_claim_violations(P.claims_features(spark, sf_dir)).select("claim_id", "is_valid", "violations")


@register("quarantine_counts", O.with_ctes(["f"], f"SELECT v = '' AS is_valid, COUNT(*) AS n FROM "
                                                  f"(SELECT {_viol_sql()} AS v FROM f) t GROUP BY 1"))
def q_quarantine_counts(spark, sf_dir):
    return (DQ.with_claim_violations(P.claims_features(spark, sf_dir))
            .groupBy("is_valid").agg(F.count(F.lit(1)).alias("n")))


# --- slice 5: sampling, split, metrics ---------------------------------------------
_BG_SEED = "background-42"
O.register("bg", f"bg AS (SELECT f.*, md5(claim_id || '|{_BG_SEED}') AS sample_key FROM f "
                 f"ORDER BY sample_key LIMIT {K.LIME_BACKGROUND_SIZE})", ["f"])
O.register("sp", "sp AS (SELECT f.*, CASE WHEN " + __import__("claimspark.functions.mathx", fromlist=["x"])
           .hash_uniform_sql("claim_id", "split-42") + f" < {K.TEST_FRACTION} THEN 'test' ELSE 'train' END AS split, "
           "ROUND(denial_prob, 10) AS score FROM f)", ["f"])


def _background(spark, sf_dir):
    return SM.uniform_sample(P.claims_features(spark, sf_dir), K.LIME_BACKGROUND_SIZE, seed=_BG_SEED)


def _split(spark, sf_dir):
    return SM.with_split(P.claims_features(spark, sf_dir)).withColumn("score", F.round("denial_prob", 10))


@register("sample_background", O.with_ctes(["bg"], "SELECT claim_id, sample_key FROM bg"))
def q_sample_background(spark, sf_dir):
    return _background(spark, sf_dir).select("claim_id", "sample_key")


@register("stratified_split", O.with_ctes(["sp"], "SELECT claim_id, split FROM sp"))
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("claim_id", "split")


@register("split_summary", O.with_ctes(["sp"], "SELECT split, COUNT(*) AS n, SUM(denial_label) AS n_denied, "
                                               "ROUND(AVG(CAST(denial_label AS DOUBLE)), 6) AS denial_rate "
                                               "FROM sp GROUP BY split"))
def q_split_summary(spark, sf_dir):
    return ME.split_summary(_split(spark, sf_dir))


@register("class_weights", O.with_ctes(["sp"], """
SELECT n_pos, n_neg, ROUND(n_neg / n_pos, 6) AS scale_pos_weight, ROUND((n_pos + n_neg) / (2.0 * n_pos), 6) AS weight_pos,
 ROUND((n_pos + n_neg) / (2.0 * n_neg), 6) AS weight_neg FROM (SELECT SUM(CASE WHEN denial_label = 1 THEN 1 ELSE 0 END)
 AS n_pos, SUM(CASE WHEN denial_label = 0 THEN 1 ELSE 0 END) AS n_neg FROM sp WHERE split = 'train') t"""))
def q_class_weights(spark, sf_dir):
    return ME.class_weights(_split(spark, sf_dir).filter(F.col("split") == "train"))


@register("column_medians", O.with_ctes(["bg"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(CAST(MEDIAN({c}) AS DOUBLE), 6) AS median FROM bg" for c in K.FEATURE_COLS)))
def q_column_medians(spark, sf_dir):
    row = _background(spark, sf_dir).agg(*[F.median(c).alias(c) for c in K.FEATURE_COLS])
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in K.FEATURE_COLS)
    return row.selectExpr(f"stack({len(K.FEATURE_COLS)}, {pairs}) AS (feature, median)") \
              .withColumn("median", F.round("median", 6))


@register("categorical_columns", O.with_ctes(["bg"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS n_distinct, COUNT(DISTINCT {c}) <= 4 AS is_categorical "
    f"FROM bg" for c in K.FEATURE_COLS)))
def q_categorical_columns(spark, sf_dir):
    row = _background(spark, sf_dir).agg(*[F.countDistinct(c).alias(c) for c in K.FEATURE_COLS])
    pairs = ", ".join(f"'{c}', `{c}`" for c in K.FEATURE_COLS)
    return (row.selectExpr(f"stack({len(K.FEATURE_COLS)}, {pairs}) AS (feature, n_distinct)")
               .withColumn("is_categorical", F.col("n_distinct") <= 4))


_CONF_SQL = ("SELECT split, SUM(CASE WHEN score >= 0.5 AND denial_label = 1 THEN 1 ELSE 0 END) AS tp, "
             "SUM(CASE WHEN score >= 0.5 AND denial_label = 0 THEN 1 ELSE 0 END) AS fp, "
             "SUM(CASE WHEN score < 0.5 AND denial_label = 0 THEN 1 ELSE 0 END) AS tn, "
             "SUM(CASE WHEN score < 0.5 AND denial_label = 1 THEN 1 ELSE 0 END) AS fn FROM sp GROUP BY split")
O.register("cf", f"cf AS ({_CONF_SQL})", ["sp"])
O.register("gsc", "gsc AS (SELECT split, score, SUM(denial_label) AS pos, SUM(1 - denial_label) AS neg FROM sp "
                  "GROUP BY split, score)", ["sp"])
O.register("gcum", "gcum AS (SELECT gsc.*, COALESCE(SUM(pos) OVER w, 0) AS pos_below, "
                   "COALESCE(SUM(neg) OVER w, 0) AS neg_below, SUM(pos) OVER (PARTITION BY split) AS P, "
                   "SUM(neg) OVER (PARTITION BY split) AS N FROM gsc WINDOW w AS (PARTITION BY split ORDER BY score "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", ["gsc"])
O.register("auc", "auc AS (SELECT split, ROUND(SUM(pos * (neg_below + 0.5 * neg)) / (MAX(P) * MAX(N)), 4) AS auc_roc, "
                  "ROUND(SUM(pos * (P - pos_below) / ((P - pos_below) + (N - neg_below))) / MAX(P), 4) "
                  "AS avg_precision FROM gcum GROUP BY split)", ["gcum"])


@register("confusion", O.with_ctes(["cf"], "SELECT * FROM cf"))
def q_confusion(spark, sf_dir):
    return ME.confusion(_split(spark, sf_dir))


@register("roc_auc", O.with_ctes(["auc"], "SELECT split, auc_roc FROM auc"))
def q_roc_auc(spark, sf_dir):
    return ME.roc_auc_ap(_split(spark, sf_dir)).select("split", "auc_roc")


@register("average_precision", O.with_ctes(["auc"], "SELECT split, avg_precision FROM auc"))
def q_average_precision(spark, sf_dir):
    return ME.roc_auc_ap(_split(spark, sf_dir)).select("split", "avg_precision")


@register("f1_precision_recall", O.with_ctes(["cf"], """
SELECT split, ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
 ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
 ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM cf"""))
def q_f1_precision_recall(spark, sf_dir):
    return ME.f1_precision_recall(ME.confusion(_split(spark, sf_dir)))


@register("risk_levels", O.with_ctes(["f"], """
SELECT claim_id, ROUND(denial_prob, 6) AS prediction_prob, CASE WHEN denial_prob > 0.5 THEN 'DENY' ELSE 'APPROVE' END
 AS recommended_action, CASE WHEN denial_prob >= 0.7 THEN 'HIGH' WHEN denial_prob >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END
 AS denial_risk_level FROM f"""))
def q_risk_levels(spark, sf_dir):
    return WI.score_table(P.claims_features(spark, sf_dir)) \
        .withColumn("prediction_prob", F.round("prediction_prob", 6))


# --- slice 6: attributions, drivers, importance, fairness, hints, what-if ----
_PHI = [f"phi_{f}" for f in K.FEATURE_COLS]


@register("scorecard_shap", O.with_ctes(["sh"], "SELECT claim_id, ROUND(base_value, 6) AS base_value, "
                                                "ROUND(base_value + " + " + ".join(_PHI) + ", 6) AS log_odds, "
                                                + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _PHI) + " FROM sh"))
def q_scorecard_shap(spark, sf_dir):
    s = P.scorecard_shap(spark, sf_dir)
    return s.select("claim_id", *[F.round(c, 6).alias(c) for c in ["base_value", "log_odds", *_PHI]])


@register("attribution_map", O.with_ctes(["sh"], "SELECT claim_id, MAP([" + ", ".join(f"'{f}'" for f in K.FEATURE_COLS) + "], ["
                                                 + ", ".join(f"ROUND({c}, 6)" for c in _PHI) + "]) AS attributions FROM sh"))
def q_attribution_map(spark, sf_dir):
    """MAP-1: one map of feature to attribution per claim."""
    attributions = F.transform_values(SH.shap_map(), lambda _, v: F.round(v, 6))
    return P.scorecard_shap(spark, sf_dir).select("claim_id", attributions.alias("attributions"))


@register("top_drivers", O.with_ctes(["rk"], """
SELECT claim_id, rnk AS rank, feature, ROUND(value, 6) AS shap_value,
 CASE WHEN value > 0 THEN 'increases_denial' ELSE 'decreases_denial' END AS direction FROM rk WHERE rnk <= 10"""))
def q_top_drivers(spark, sf_dir):
    return SH.top_drivers(P.scorecard_shap(spark, sf_dir), k=10).withColumn("rank", F.col("rank").cast("long"))


_N_OTHER = len(K.FEATURE_COLS) - 14
O.register("wf", f"""wf AS (SELECT claim_id, rnk AS step, feature, value FROM rk WHERE rnk <= 14 UNION ALL
 SELECT claim_id, 15 AS step, '{_N_OTHER} other features' AS feature, SUM(value) AS value FROM rk WHERE rnk > 14
 GROUP BY claim_id)""", ["rk"])


@register("waterfall", O.with_ctes(["wf", "sh"], """
SELECT wf.claim_id, step, feature, ROUND(value, 6) AS shap_value,
 ROUND(sh.base_value + SUM(value) OVER (PARTITION BY wf.claim_id ORDER BY step ROWS UNBOUNDED PRECEDING), 6)
 AS cumulative FROM wf JOIN sh ON wf.claim_id = sh.claim_id"""))
def q_waterfall(spark, sf_dir):
    return SH.waterfall(P.scorecard_shap(spark, sf_dir)).withColumn("step", F.col("step").cast("long"))


@register("global_importance", O.with_ctes(["gi"], "SELECT feature, mean_abs_shap, rank FROM gi"))
def q_global_importance(spark, sf_dir):
    return SH.global_importance(P.scorecard_shap(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@register("beeswarm_summary", O.with_ctes(["lg"], """
SELECT feature, COUNT(*) AS n, ROUND(AVG(ABS(value)), 6) AS mean_abs_shap, ROUND(AVG(value), 6) AS mean_shap,
 SUM(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS n_positive,
 ROUND(AVG(CASE WHEN value > 0 THEN x END), 6) AS mean_value_when_positive,
 ROUND(AVG(CASE WHEN NOT (value > 0) THEN x END), 6) AS mean_value_when_not_positive,
 """ + ", ".join(f"ROUND(quantile_disc(value, {q}), 6) AS {name}" for name, q in SH.BEESWARM_QUANTILES.items()) + """,
 CASE WHEN MIN(value) < MAX(value) AND MIN(x) < MAX(x) THEN ROUND(corr(value, x), 6) END AS corr_with_value FROM lg GROUP BY feature"""))
def q_beeswarm_summary(spark, sf_dir):
    return SH.beeswarm_summary(P.scorecard_shap(spark, sf_dir))


_PROT = ", ".join(f"'{f}'" for f in K.PROTECTED_FEATURES)


@register("protected_rank", O.with_ctes(["gi"], f"""
SELECT feature, rank, mean_abs_shap, ROUND(CASE WHEN top > 0 THEN mean_abs_shap / top * 100 ELSE 0.0 END, 4)
 AS pct_of_top, rank <= 10 AS in_top_k FROM gi, (SELECT MAX(mean_abs_shap) AS top FROM gi) t
 WHERE feature IN ({_PROT})"""))
def q_protected_rank(spark, sf_dir):
    return WI.protected_rank(P.scorecard_shap(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@register("counterfactual_hints", O.with_ctes(["rk", "ht", "f"], f"""
SELECT claim_id, hint_rank, hint FROM (
 SELECT rk.claim_id, ROW_NUMBER() OVER (PARTITION BY rk.claim_id ORDER BY rnk) AS hint_rank,
  '[' || rk.feature || '  SHAP=' || printf('%+.4f', ROUND(value, 4)) || ']  ' || COALESCE(ht.hint, '{O._q(K.DEFAULT_HINT)}')
  AS hint FROM rk JOIN f ON rk.claim_id = f.claim_id LEFT JOIN ht ON rk.feature = ht.feature
 WHERE f.denial_prob > 0.5 AND value > 0) t WHERE hint_rank <= 3
UNION ALL SELECT claim_id, 1 AS hint_rank, '{O._q(K.APPROVED_HINT)}' AS hint FROM f WHERE NOT (denial_prob > 0.5)"""))
def q_counterfactual_hints(spark, sf_dir):
    return SH.counterfactual_hints(P.scorecard_shap(spark, sf_dir)).withColumn("hint_rank",
                                                                                F.col("hint_rank").cast("long"))


@register("what_if_prior_auth", O.with_ctes(["sh"], f"""
SELECT claim_id, ROUND(p0, 6) AS prob_original, ROUND(p1, 6) AS prob_corrected, ROUND(p0 - p1, 6) AS abs_change,
 ROUND(CASE WHEN p0 > 0 THEN (p0 - p1) / p0 END, 6) AS rel_change, ROUND(phi_prior_auth_present, 6) AS shap_original,
 ROUND(-{K.W_NO_PRIOR_AUTH!r} * m_no_prior_auth, 6) AS shap_corrected,
 ROUND(-{K.W_NO_PRIOR_AUTH!r} * m_no_prior_auth - phi_prior_auth_present, 6) AS shap_shift,
 CASE WHEN p0 > 0.5 THEN 'DENY' ELSE 'APPROVE' END AS action_original,
 CASE WHEN p1 > 0.5 THEN 'DENY' ELSE 'APPROVE' END AS action_corrected
FROM (SELECT sh.*, m_no_prior_auth, denial_prob AS p0,
  1.0 / (1.0 + EXP(-GREATEST(-20.0, LEAST(20.0, {O.LO_SQL.replace('prior_auth_present', '1')})))) AS p1
  FROM sh, mu, ic WHERE prior_auth_present = 0) t"""))
def q_what_if_prior_auth(spark, sf_dir):
    f = P.claims_features(spark, sf_dir).filter(F.col("prior_auth_present") == 0)
    return WI.what_if(f, P.intercept(spark, sf_dir), P.background_means(spark, sf_dir), WI.PRIOR_AUTH_FIX)


def _risk_sql(p):
    return f"CASE WHEN {p} >= 0.7 THEN 'HIGH' WHEN {p} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def _legs_sql(rows: str) -> str:
    """Three legs from ``rows``: the claim under its scenario, with ``p0``, ``phi0`` and the background means."""
    focus = f"{K.W_NO_PRIOR_AUTH!r} * ((1.0 - COALESCE(CAST(prior_auth_present AS DOUBLE), 0.0)) - m_no_prior_auth)"
    base = O.LO_SQL
    for f in ("is_inpatient", "los_days", "clm_pmt_amt", "prior_auth_present", "primary_icd9_num", "chronic_count",
              "bene_hi_mons", "bene_hmo_mons"):
        base = base.replace(f"CAST({f} AS", f"CAST({K.DOCUMENTED_CLAIM[f]!r} AS")
    clipped = "1.0 / (1.0 + EXP(-GREATEST(-20.0, LEAST(20.0, {}))))"
    return f"""
SELECT sample_num, claim_id, scenario, '' AS ignored, ROUND(p0, 6) AS prob_original, ROUND(p1, 6) AS prob_corrected, ROUND(pb, 6) AS prob_baseline,
 ROUND(p0 - p1, 6) AS abs_change, ROUND(CASE WHEN p0 > 0 THEN (p0 - p1) / p0 END, 6) AS rel_change, ROUND(p1 - pb, 6) AS above_baseline,
 ROUND(phi0, 6) AS shap_original, ROUND(phi1, 6) AS shap_corrected, ROUND(phi1 - phi0, 6) AS shap_shift,
 CASE WHEN p0 > 0.5 THEN 'DENY' ELSE 'APPROVE' END AS action_original, CASE WHEN p1 > 0.5 THEN 'DENY' ELSE 'APPROVE' END AS action_corrected,
 CASE WHEN pb > 0.5 THEN 'DENY' ELSE 'APPROVE' END AS action_baseline,
 {_risk_sql('p0')} AS risk_original, {_risk_sql('p1')} AS risk_corrected, {_risk_sql('pb')} AS risk_baseline
FROM (SELECT r.*, {focus} AS phi1, {clipped.format(O.LO_SQL)} AS p1, {clipped.format(base)} AS pb FROM ({rows}) r, ic) t"""


@register("what_if_scenarios", O.with_ctes(["sh"], _legs_sql("""
SELECT claim_id, sample_num, s.scenario, denial_prob AS p0, phi_prior_auth_present AS phi0, m_no_prior_auth, is_inpatient, chronic_count, bene_hmo_mons,
 CASE WHEN s.k IN (1, 5) THEN 1 ELSE prior_auth_present END AS prior_auth_present, CASE WHEN s.k IN (2, 5) THEN 80.0 ELSE clm_pmt_amt END AS clm_pmt_amt,
 CASE WHEN s.k IN (2, 5) THEN 2 ELSE los_days END AS los_days, CASE WHEN s.k IN (3, 5) THEN 12 ELSE bene_hi_mons END AS bene_hi_mons,
 CASE s.k WHEN 4 THEN NULL WHEN 5 THEN 401 ELSE primary_icd9_num END AS primary_icd9_num
FROM sh, mu, (VALUES """ + ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(K.WHAT_IF_SCENARIOS)) + ") s(k, scenario)")))
def q_what_if_scenarios(spark, sf_dir):
    """XAI-8, JOIN-3: every claim under a table of scenarios, beside its own and the documented claim's score."""
    table = spark.createDataFrame(K.WHAT_IF_SCENARIOS, "scenario string, changes map<string,double>")
    return WI.what_if_scenarios(P.claims_features(spark, sf_dir), table, P.intercept(spark, sf_dir), P.background_means(spark, sf_dir))


@register("what_if_own_corrections", O.with_ctes(["sh"], _legs_sql("""
SELECT claim_id, sample_num, 'own' AS scenario, denial_prob AS p0, phi_prior_auth_present AS phi0, m_no_prior_auth, is_inpatient, los_days, chronic_count,
 bene_hi_mons, bene_hmo_mons, primary_icd9_num, 1 AS prior_auth_present, CASE WHEN clm_pmt_amt <= 0 THEN 80.0 ELSE clm_pmt_amt END AS clm_pmt_amt
FROM sh, mu WHERE prior_auth_present = 0""")))
def q_what_if_own_corrections(spark, sf_dir):
    """XAI-8 with a corrections table by claim: what each unauthorised claim lacks, filled in."""
    f = P.claims_features(spark, sf_dir)
    fill = F.map_filter(F.create_map(F.lit("prior_auth_present"), F.lit(1.0), F.lit("clm_pmt_amt"), F.when(F.col("clm_pmt_amt") <= 0, 80.0)),
                        lambda _, v: v.isNotNull())
    table = f.filter(F.col("prior_auth_present") == 0).select("sample_num", "claim_id", F.lit("own").alias("scenario"), fill.alias("changes"))
    return WI.what_if_scenarios(f, table, P.intercept(spark, sf_dir), P.background_means(spark, sf_dir))


# --- slice 7: audit -----------------------------------------------------------
_AV = ("CASE WHEN final_decision IS NULL OR NOT regexp_matches(final_decision, '^(APPROVE|DENY)$') THEN 'decision' END, "
       "CASE WHEN override_reason IS NULL OR length(override_reason) < 5 THEN 'reason_too_short' END")
O.register("av", f"av AS (SELECT raw_overrides.*, concat_ws(',', {_AV}) AS violations FROM raw_overrides)",
           ["raw_overrides"])
O.register("al", "al AS (SELECT audit_id, claim_id, member_id, adjuster_name, model_decision, model_prob, "
                 "final_decision, override_reason, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp "
                 "FROM av WHERE violations = '')", ["av"])


def _audit_log(spark, sf_dir):
    checked = DQ.with_override_violations(FX.raw_overrides(spark, sf_dir))
    return (checked.filter("is_valid")
                   .withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
                   .select(*AU.AUDIT_COLUMNS))


@register("audit_validate", O.with_ctes(["av"], "SELECT audit_id, violations = '' AS is_valid, violations FROM av"))
def q_audit_validate(spark, sf_dir):
    return DQ.with_override_violations(FX.raw_overrides(spark, sf_dir)).select("audit_id", "is_valid", "violations")


@register("audit_page", O.with_ctes(["al"], """
SELECT al.*, (SELECT COUNT(*) FROM al) AS total, 2 AS page, 20 AS page_size FROM al
ORDER BY timestamp, audit_id LIMIT 20 OFFSET 20"""))
def q_audit_page(spark, sf_dir):
    return AU.page(_audit_log(spark, sf_dir), page_no=2, page_size=20)


@register("audit_report", O.with_ctes(["al"], f"""
SELECT audit_id, claim_id, adjuster_name, model_decision, final_decision,
 CASE WHEN length(override_reason) > {K.AUDIT_REASON_DISPLAY_LEN} THEN substr(override_reason, 1,
 {K.AUDIT_REASON_DISPLAY_LEN}) || '...' ELSE override_reason END AS reason_short,
 final_decision <> model_decision AS is_override FROM al"""))
def q_audit_report(spark, sf_dir):
    return AU.report(_audit_log(spark, sf_dir))


# --- slice 10: letters and checks ----------------------------------------------
from ..operators import report as RP  # noqa: E402

LETTER_DATE = "2008-12-31"  # fixed report date so letter text is reproducible


@register("letter_compliance", O.with_ctes(["sh"], "SELECT claim_id, denial_prob > 0.5 AS has_denial_reasons, "
                                                   "TRUE AS has_appeal_right, TRUE AS has_appeal_window, "
                                                   "TRUE AS has_contact, TRUE AS has_ai_disclosure, "
                                                   "denial_prob > 0.5 AND GREATEST(" + ", ".join(
                                                       f"{c} > 0" for c in _PHI) + ") AS has_corrective_actions "
                                                   "FROM sh"))
def q_letter_compliance(spark, sf_dir):
    return RP.compliance(RP.letters(P.scorecard_shap(spark, sf_dir), today=LETTER_DATE))


@register("scorecard_letters")
def q_scorecard_letters(spark, sf_dir):
    """Member letter + adjuster summary per claim from the scorecard attributions."""
    return RP.letters(P.scorecard_shap(spark, sf_dir), today=LETTER_DATE)


# --- slices 8-9: trained models, Tree SHAP, LIME (rows-only checks) -----------
from . import models as M  # noqa: E402
from ..operators import explain as EX  # noqa: E402
from ..operators import model as MD  # noqa: E402


@register("gbt_score")
def q_gbt_score(spark, sf_dir):
    return M.gbt_score(spark, sf_dir)


@register("gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    return M.metrics(spark, sf_dir, "champion").unionByName(M.metrics(spark, sf_dir, "challenger"))


@register("training_rows", O.with_ctes(["sp"], """
SELECT m AS model, COUNT(*) AS n_rows, TRUE AS stopped_in_bounds, TRUE AS best_is_first_maximum, TRUE AS cut_after_best
FROM sp, (VALUES ('champion'), ('challenger')) t(m) WHERE split = 'train' GROUP BY m"""))
def q_training_rows(spark, sf_dir):
    """ML-1, ML-2: rows that each model is fitted on (all training rows), and that its rounds end where they should."""
    rows = []
    for name in ("champion", "challenger"):
        t = M.trained(spark, sf_dir, name)
        most = int(t.params.get("maxIter") or t.params["numTrees"])
        later = t.history[t.best_iteration + 1:]
        rows.append((name, int(t.params["n_rows"]), len(t.history) <= most and (len(t.history) == most or len(later) >= K.EARLY_STOPPING_ROUNDS),
                     max(t.history[:t.best_iteration + K.EARLY_STOPPING_ROUNDS + 1]) == t.history[t.best_iteration] > max((0.0, *t.history[:t.best_iteration])),
                     t.model.stages[-1].getNumTrees == t.best_iteration + 1))
    return spark.createDataFrame(rows, "model string, n_rows long, stopped_in_bounds boolean, best_is_first_maximum boolean, cut_after_best boolean")


@register("training_history")
def q_training_history(spark, sf_dir):
    """ML-1, ML-2: AUC on the test rows after every round, and which round is kept."""
    rows = [(name, k, round(auc, 6), k == t.best_iteration) for name in ("champion", "challenger")
            for t in [M.trained(spark, sf_dir, name)] for k, auc in enumerate(t.history)]
    return spark.createDataFrame(rows, "model string, iteration int, auc double, is_best boolean")


@register("gbt_importance")
def q_gbt_importance(spark, sf_dir):
    return MD.importance(spark, M.trained(spark, sf_dir, "champion"))


@register("champion_challenger")
def q_champion_challenger(spark, sf_dir):
    return MD.compare_runs(M.runs(spark, sf_dir))


@register("tree_shap")
def q_tree_shap(spark, sf_dir):
    return M.tree_shap(spark, sf_dir).drop("bene_id")


@register("lime_reasons")
def q_lime_reasons(spark, sf_dir):
    return M.lime_reasons(spark, sf_dir)


@register("shap_lime_agreement")
def q_shap_lime_agreement(spark, sf_dir):
    """XAI-7: share of explained claims whose top SHAP and top LIME feature agree."""
    return EX.agreement(M.explained(spark, sf_dir))


def _model_letters(spark, sf_dir):
    return RP.letters(M.explained(spark, sf_dir), today=LETTER_DATE, model_name="Spark ML GBT (champion)")


@register("letters_complete", O.with_ctes(["cr"], "SELECT COUNT(*) AS n_claims, 0 AS null_letters, 0 AS null_summaries FROM cr"))
def q_letters_complete(spark, sf_dir):
    """Every claim has a letter and a summary, approved or not."""
    return _model_letters(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("member_letter").isNull()).cast("int").alias("null_letters"),
        F.count_if(F.col("adjuster_summary").isNull()).cast("int").alias("null_summaries"))


@register("lime_coverage", O.with_ctes(["cr"], "SELECT COUNT(*) AS n_claims, COUNT(*) AS n_explained FROM cr"))
def q_lime_coverage(spark, sf_dir):
    """Claims, and claims that LIME explains."""
    return M.explained(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.size("reasons") > 0).alias("n_explained"))


@register("explanation_checks", O.with_ctes(["cr"], "SELECT COUNT(*) AS n_claims, 0 AS not_additive, 0 AS wrong_probability, 0 AS wrong_reason_count, 0 AS wrong_order, "
                                                    "0 AS wrong_direction, 0 AS wrong_local_prediction FROM cr"))
def q_explanation_checks(spark, sf_dir):
    """What must hold for every claim: base + attributions = log-odds, the probability is its sigmoid and the model's own,
    ten reasons by falling size with their directions, and a local prediction near LIME's probability scale."""
    e = M.explained(spark, sf_dir).join(M.gbt_score(spark, sf_dir).select("claim_id", F.col("prediction_prob").alias("p")), "claim_id")
    total = sum((F.col(f"phi_{f}") for f in K.FEATURE_COLS), F.col("base_value"))
    sizes = F.transform("reasons", lambda r: F.round(F.abs(r["coeff"]), 12))
    bad = {"not_additive": F.abs(total - F.col("log_odds")) > 1e-9, "wrong_probability": F.abs(1 / (1 + F.exp(-total)) - F.col("p")) > 1e-9,
           "wrong_reason_count": F.size("reasons") != K.LIME_NUM_FEATURES, "wrong_order": sizes != F.reverse(F.array_sort(sizes)),
           "wrong_direction": F.exists("reasons", lambda r: (r["direction"] == "increases_denial") != (r["coeff"] > 0)),
           "wrong_local_prediction": ~F.col("local_pred").between(-1.0, 2.0)}
    return e.agg(F.count(F.lit(1)).alias("n_claims"), *[F.count_if(c).cast("int").alias(k) for k, c in bad.items()])


@register("member_letters")
def q_member_letters(spark, sf_dir):
    return _model_letters(spark, sf_dir).select("claim_id", "member_letter")


@register("adjuster_summaries")
def q_adjuster_summaries(spark, sf_dir):
    return _model_letters(spark, sf_dir).select("claim_id", "adjuster_summary")


# --- slice 11: file sources and streams ------------------------------------------
import hashlib as _hashlib  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import samples as SMP  # noqa: E402
from ..streaming import streams as ST  # noqa: E402


def _stage_root(spark, sf_dir, what):
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/staging/{_hashlib.md5(sf_dir.encode()).hexdigest()[:10]}/{what}"


def _write_csv(df, path):
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


#: What sample 2's files lack; its other columns come in another order.
_LACKING = {"IP": ["OP_PHYSN_NPI", "ICD9_PRCDR_CD_2"], "OP": ["ICD9_DGNS_CD_3"], "BENE": ["SP_STRKETIA", "BENE_HMO_CVRAGE_TOT_MONS"]}
_FILES = {"IP": "DE1_0_2008_to_2010_Inpatient_Claims_Sample_{}.csv", "OP": "DE1_0_2008_to_2010_Outpatient_Claims_Sample_{}.csv",
          "BENE": "DE1_0_2008_Beneficiary_Summary_File_Sample_{}.csv"}
_SAMPLES = [1, 2, 3, 4]  # sample 3 has a malformed record, sample 4 no file


def stage_raw_files(spark, sf_dir) -> str:
    """Write the adapter's raw tables as per-sample CSV files (the raw file layout) and return their folder.

    Samples 1 and 2 share the claims but for every tenth, and differ in header;
    sample 3 has the rest and one record that is cut short. The claims are
    derived once and written by sample and kind, from where each file's rows come.
    """
    run = _uuid.uuid4().hex
    root, table = _stage_root(spark, sf_dir, f"raw/{run}"), _stage_root(spark, sf_dir, f"raw-claims/{run}")
    n = F.col("CLM_ID").cast("long")
    of = F.when(n % 10 == 9, 3).otherwise(1 + n % 2).cast("int")
    raw = FX.raw_claims(spark, sf_dir).withColumns({"of_sample": of, "of_kind": F.col("claim_type")})
    raw.write.partitionBy("of_sample", "of_kind").parquet(table)
    raw = spark.read.schema(raw.schema).parquet(table)
    bene = FX.raw_bene(spark, sf_dir)
    for sample in (1, 2, 3):
        for kind in ("IP", "OP", "BENE"):
            wanted = {"IP": K.IP_COLS, "OP": K.OP_COLS, "BENE": bene.columns}[kind]
            part = bene if kind == "BENE" else raw.filter((F.col("of_kind") == kind) & (F.col("of_sample") == sample))
            cols = [c for c in wanted if c in part.columns]
            if sample == 2:
                cols = [c for c in reversed(cols) if c not in _LACKING[kind]]
            path = f"{root}/{_FILES[kind].format(sample)}"
            _write_csv(part.select(*cols), path)
            if sample == 3 and kind == "OP":
                spark.createDataFrame([(",".join(cols),), ("cut,short",)], "value string").coalesce(1).write.mode("append").text(path)
    return root


O.register("cs", "cs AS (SELECT cc.*, CASE WHEN CAST(claim_id AS BIGINT) % 10 = 9 THEN 3 ELSE 1 + CAST(claim_id AS BIGINT) % 2 END AS s FROM cc)", ["cc"])
_CSV_SQL = """SELECT cs.* EXCLUDE (s) REPLACE (
  CASE WHEN s = 2 AND claim_type = 'IP' THEN NULL ELSE OP_PHYSN_NPI END AS OP_PHYSN_NPI,
  CASE WHEN s = 2 AND claim_type = 'IP' THEN NULL ELSE ICD9_PRCDR_CD_2 END AS ICD9_PRCDR_CD_2,
  CASE WHEN s = 2 AND claim_type = 'OP' THEN NULL ELSE ICD9_DGNS_CD_3 END AS ICD9_DGNS_CD_3),
 cb.* EXCLUDE (bene_id) REPLACE (CASE WHEN s = 2 THEN NULL ELSE SP_STRKETIA END AS SP_STRKETIA,
  CASE WHEN s = 2 THEN NULL ELSE BENE_HMO_CVRAGE_TOT_MONS END AS BENE_HMO_CVRAGE_TOT_MONS), CAST(s AS INTEGER) AS sample_num
FROM cs LEFT JOIN cb ON cs.bene_id = cb.bene_id WHERE s < 3"""


@register("csv_ingest", O.with_ctes(["cs", "cb"], _CSV_SQL))
def q_csv_ingest(spark, sf_dir):
    """SRC-1..5: raw CSV files of several samples, each with its own header -> the 45-column claims_raw table."""
    return SMP.load(spark, SMP.stage(spark, stage_raw_files(spark, sf_dir), _SAMPLES), _SAMPLES)


_RAW_N = ("SELECT CASE WHEN CAST(CLM_ID AS BIGINT) % 10 = 9 THEN 3 ELSE 1 + CAST(CLM_ID AS BIGINT) % 2 END AS s, claim_type AS kind, COUNT(*) AS n "
          "FROM raw_claims GROUP BY 1, 2 UNION ALL SELECT s, 'BENE', COUNT(*) FROM raw_bene, (VALUES (1), (2), (3)) t(s) GROUP BY s")


@register("sample_status", O.with_ctes(["raw_claims", "raw_bene"], f"""
SELECT CAST(s AS INTEGER) AS sample_num, kind, CASE WHEN s = 4 THEN 'missing' WHEN s = 3 AND kind = 'OP' THEN 'failed' ELSE 'loaded' END AS status,
 CAST(COALESCE(n, 0) + CASE WHEN s = 3 AND kind = 'OP' THEN 1 ELSE 0 END AS BIGINT) AS n_rows, CAST(CASE WHEN s = 3 AND kind = 'OP' THEN 1 ELSE 0 END AS BIGINT) AS n_bad,
 CASE WHEN s = 4 THEN 'no file' WHEN s = 3 AND kind = 'OP' THEN '1 malformed records' ELSE '' END AS reason, s < 3 AS sample_loaded
FROM (SELECT * FROM (VALUES (1), (2), (3), (4)) a(s), (VALUES ('BENE'), ('IP'), ('OP')) b(kind)) LEFT JOIN ({_RAW_N}) USING (s, kind)"""))
def q_sample_status(spark, sf_dir):
    """SRC-5: what became of every wanted sample: loaded, missing, or failed and why."""
    return SMP.sample_status(spark, SMP.stage(spark, stage_raw_files(spark, sf_dir), _SAMPLES), _SAMPLES)


@register("schema_drift", O.with_ctes(["raw_claims", "raw_bene"], "SELECT DISTINCT kind, s AS sample_num, c AS missing_column FROM (VALUES "
                                      + ", ".join(f"('{k}', '{c}')" for k in ("IP", "OP", "BENE") for c in SMP.WANTED[k]) + ") w(kind, c), (VALUES (1), (2), (3)) t(s) "
                                      "WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM raw_claims)) AND c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM raw_bene)) "
                                      "OR s = 2 AND (kind, c) IN (VALUES " + ", ".join(f"('{k}', '{c}')" for k, cs in _LACKING.items() for c in cs) + ")"))
def q_schema_drift(spark, sf_dir):
    """SRC-4: wanted columns that the files of a sample don't have."""
    found = SMP.discover(spark, stage_raw_files(spark, sf_dir), _SAMPLES)
    paths = [r.path for r in found.filter("form = 'csv'").select("path").collect()]
    return SMP.schema_drift(found, SMP.headers(spark, paths)).select("kind", "sample_num", "missing_column").distinct()


@register("stream_scores", O.with_ctes(["f"], """
SELECT claim_id, ROUND(denial_prob, 6) AS prediction_prob, CASE WHEN denial_prob > 0.5 THEN 'DENY' ELSE 'APPROVE' END
 AS recommended_action, CASE WHEN denial_prob >= 0.7 THEN 'HIGH' WHEN denial_prob >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END
 AS denial_risk_level FROM f"""))
def q_stream_scores(spark, sf_dir):
    """ST-1: raw claims arrive as files; the stream scores them (= batch risk_levels)."""
    src = _stage_root(spark, sf_dir, "claims_in")
    raw = FX.raw_claims(spark, sf_dir)
    raw.repartition(8, "CLM_ID").write.mode("overwrite").parquet(src)
    bene = IN.clean_bene(FX.raw_bene(spark, sf_dir))
    stream = ST.score_claims(ST.claims_stream(spark, src, raw.schema), bene, P.intercept(spark, sf_dir))
    run = _uuid.uuid4().hex  # each run gets its own sink and progress folder
    sink, ck = _stage_root(spark, sf_dir, f"scores/{run}/out"), _stage_root(spark, sf_dir, f"scores/{run}/ck")
    ST.run_available(stream, sink, ck)
    return spark.read.parquet(sink).withColumn("prediction_prob", F.round("prediction_prob", 6))


@register("stream_audit", O.with_ctes(["al"], "SELECT * FROM al"))
def q_stream_audit(spark, sf_dir):
    """ST-2: override requests arrive as files, delivered twice; the stream keeps
    the valid ones once each."""
    src = _stage_root(spark, sf_dir, "overrides_in")
    ov = FX.raw_overrides(spark, sf_dir)
    ov.write.mode("overwrite").parquet(f"{src}/batch=1")
    ov.write.mode("overwrite").parquet(f"{src}/batch=2")  # redelivery of the same requests
    run = _uuid.uuid4().hex
    log, ck = _stage_root(spark, sf_dir, f"audit/{run}/log"), _stage_root(spark, sf_dir, f"audit/{run}/ck")
    stream = ST.audit_entries(spark.readStream.schema(ov.schema).option("maxFilesPerTrigger", 8)
                              .parquet(f"{src}/*"))
    ST.run_audit(stream, log, ck)
    return AU.read_log(spark, log).drop("day")


# --- remaining user-level operators -------------------------------------------------

@register("demo_claim", O.with_ctes(["f"], "SELECT claim_id, ROUND(denial_prob, 6) AS denial_prob FROM f "
                                          "WHERE denial_label = 1 AND prior_auth_present = 0 "
                                          "ORDER BY claim_id LIMIT 1"))
def q_demo_claim(spark, sf_dir):
    """FLT-2: the first denied claim with no prior authorisation (by claim id)."""
    f = P.claims_features(spark, sf_dir)
    return (f.filter((F.col("denial_label") == 1) & (F.col("prior_auth_present") == 0))
             .orderBy("claim_id").limit(1).select("claim_id", F.round("denial_prob", 6).alias("denial_prob")))


_REQ_NOW = "2008-12-31T00:00:00.000000+00:00"


def _requests(spark, sf_dir):
    ov = FX.raw_overrides(spark, sf_dir)
    return ov.select("claim_id", "member_id", "adjuster_name", F.col("model_prob").alias("original_prob"),
                     F.col("model_decision").alias("recommended_action"),
                     F.col("final_decision").alias("override_decision"), F.col("override_reason").alias("reason"), F.col("timestamp").alias("requested_at"))


_ID_FIELDS = " || '|' || ".join(f"COALESCE(length({v}) || ':' || {v}, '-')" for v in (
    "claim_id", "member_id", "adjuster_name", "CAST(CAST(model_prob AS DECIMAL(18,6)) AS VARCHAR)", "model_decision", "final_decision", "override_reason",
    "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')"))
_REQUEST_ENTRIES = f"""SELECT DISTINCT md5({_ID_FIELDS}) AS audit_id, claim_id,
 COALESCE(member_id, '') AS member_id, COALESCE(adjuster_name, '') AS adjuster_name, model_decision,
 ROUND(model_prob, 4) AS model_prob, final_decision, override_reason, '{_REQ_NOW}' AS timestamp,
 COALESCE(strftime(timestamp, '%Y-%m-%d'), 'unknown') AS day
FROM raw_overrides WHERE regexp_matches(final_decision, '^(APPROVE|DENY)$') AND length(override_reason) >= 5"""


@register("audit_from_requests", O.with_ctes(["raw_overrides"], f"SELECT *, final_decision <> model_decision AS is_override FROM ({_REQUEST_ENTRIES})"))
def q_audit_from_requests(spark, sf_dir):
    """AUD-1: validated override requests -> audit entries (fixed clock for the check)."""
    return AU.with_is_override(AU.entries_from_requests(_requests(spark, sf_dir), now=F.lit(_REQ_NOW)).withColumn("timestamp", F.lit(_REQ_NOW)))


@register("audit_append", O.with_ctes(["raw_overrides"], f"""
SELECT (SELECT COUNT(*) FROM ({_REQUEST_ENTRIES})) AS n_entries, (SELECT COUNT(*) FROM ({_REQUEST_ENTRIES})) AS n_ids,
 CAST(0 AS BIGINT) AS added_by_rerun, CAST(0 AS BIGINT) AS added_by_redelivery"""))
def q_audit_append(spark, sf_dir):
    """SNK-4: the log after its batch was appended, appended again under its number, and delivered again under another."""
    log = _stage_root(spark, sf_dir, f"audit-log/{_uuid.uuid4().hex}")
    entries = AU.entries_from_requests(_requests(spark, sf_dir), now=F.lit(_REQ_NOW))
    added = [AU.append_entries(entries, log, batch) for batch in ("first", "first", "second")]
    return AU.read_log(spark, log).agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("audit_id").alias("n_ids")).withColumns(
        {"added_by_rerun": F.lit(added[1]).cast("long"), "added_by_redelivery": F.lit(added[2]).cast("long")})


@register("audit_page_after", O.with_ctes(["al"], """
SELECT b.* FROM (SELECT * FROM al ORDER BY timestamp, audit_id LIMIT 60) b LEFT JOIN (SELECT audit_id FROM al ORDER BY timestamp, audit_id LIMIT 40) a
 ON a.audit_id = b.audit_id WHERE a.audit_id IS NULL"""))
def q_audit_page_after(spark, sf_dir):
    """WIN-6 by key: the third page, each page asked for after the last entry of the one before."""
    log, after = _audit_log(spark, sf_dir), None
    for _ in range(2):
        last = AU.page_after(log, after, 20).collect()[-1]
        after = (last.timestamp, last.audit_id)
    return AU.page_after(log, after, 20)


@register("shap_global_sample")
def q_shap_global_sample(spark, sf_dir):
    """XAI-1: Tree SHAP on a 2,000-claim uniform sample, with its sample index.

    Claims are sampled first, so only the sampled rows are explained."""
    from pyspark.sql import Window
    from ..operators import treeshap as TS
    smp = SM.uniform_sample(P.claims_features(spark, sf_dir), K.SHAP_SAMPLE_SIZE, seed="shap-42")
    # index within the sample: at most 2,000 rows in this window
    smp = smp.withColumn("sample_idx", F.row_number().over(Window.orderBy("sample_key")) - 1)
    ts = TS.tree_shap(smp, M.tree_arrays(spark, sf_dir))
    return ts.join(smp.select("claim_id", "sample_idx"), "claim_id") \
             .select("sample_idx", "claim_id", *[f"phi_{f}" for f in K.FEATURE_COLS])


@register("gbt_global_importance")
def q_gbt_global_importance(spark, sf_dir):
    """AGG-5 on the trained model: mean |Tree SHAP| per feature over all claims."""
    return SH.global_importance(M.tree_shap(spark, sf_dir))


@register("gbt_protected_rank")
def q_gbt_protected_rank(spark, sf_dir):
    """FAIR-1 on the trained model's attributions."""
    return WI.protected_rank(M.tree_shap(spark, sf_dir))


@register("tree_shap_drivers")
def q_tree_shap_drivers(spark, sf_dir):
    """WIN-2 on the trained model: top-10 Tree SHAP drivers per claim."""
    return SH.top_drivers(M.tree_shap(spark, sf_dir), k=10)


@register("tree_shap_waterfall")
def q_tree_shap_waterfall(spark, sf_dir):
    """WIN-4 on the trained model."""
    return SH.waterfall(M.tree_shap(spark, sf_dir))


@register("model_hints")
def q_model_hints(spark, sf_dir):
    """XAI-4 on the trained model: corrective hints for claims it would deny."""
    return SH.counterfactual_hints(M.tree_shap(spark, sf_dir))


@register("model_what_if")
def q_model_what_if(spark, sf_dir):
    """XAI-8 on the trained model: claims without prior auth, rescored with it."""
    from ..operators import treeshap as TS
    f = P.claims_features(spark, sf_dir).filter(F.col("prior_auth_present") == 0)
    return TS.what_if(f, M.tree_arrays(spark, sf_dir), WI.PRIOR_AUTH_FIX)


@register("model_what_if_scenarios")
def q_model_what_if_scenarios(spark, sf_dir):
    """XAI-8 on the trained model: every claim under a table of scenarios."""
    from ..operators import treeshap as TS
    table = spark.createDataFrame(K.WHAT_IF_SCENARIOS, "scenario string, changes map<string,double>")
    return TS.what_if_scenarios(P.claims_features(spark, sf_dir), M.tree_arrays(spark, sf_dir), table)
