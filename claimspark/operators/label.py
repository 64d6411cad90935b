"""Calibrated synthetic denial label (AGG-2, MTH-1..3, AGG-4).

log_odds = logit(mean(survey denial_rate)) + scorecard terms; the label is a
Bernoulli draw whose uniform comes from a hash of the claim id, so the label
does not depend on partitioning, row order or executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.mathx import hash_uniform, logit, sigmoid


def base_rate(rates: DataFrame) -> DataFrame:
    """AGG-2: unweighted mean of segment rates and its logit, one row."""
    return (rates.agg(F.avg("denial_rate").alias("base_rate"))
                 .withColumn("intercept", F.log(F.col("base_rate") / (F.lit(1.0) - F.col("base_rate")))))


def intercept_of(rates: DataFrame) -> float:
    """The intercept as a driver scalar (one aggregated row is collected)."""
    b = rates.agg(F.avg("denial_rate")).first()[0]
    return logit(float(b))


def scorecard_terms() -> list[tuple[str, float, Column]]:
    """The eight (name, weight, term) scorecard parts with their null rules."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    b = lambda cond: cond.cast("double")
    return [
        ("no_prior_auth", K.W_NO_PRIOR_AUTH, F.lit(1.0) - z("prior_auth_present")),
        ("zero_or_neg_payment", K.W_ZERO_OR_NEG_PAYMENT, b(z("clm_pmt_amt") <= 0)),
        ("vcode_primary", K.W_VCODE_PRIMARY, b(z("primary_icd9_num") >= 900)),
        ("zero_los_inpatient", K.W_ZERO_LOS_INPATIENT,
         b((z("is_inpatient") == 1) & (F.coalesce(F.col("los_days").cast("double"), F.lit(1.0)) <= 0))),
        ("high_cost", K.W_HIGH_COST, b(z("clm_pmt_amt") > K.HIGH_COST_AMOUNT)),
        ("chronic_burden", K.W_CHRONIC_BURDEN, z("chronic_count") / 10.0),
        ("coverage_stability", K.W_COVERAGE_STABILITY, z("bene_hi_mons") / 12.0),
        ("has_hmo", K.W_HAS_HMO, b(z("bene_hmo_mons") > 0)),
    ]


def scorecard_log_odds(intercept: float) -> Column:
    expr = F.lit(intercept)
    for _, w, term in scorecard_terms():
        expr = expr + F.lit(w) * term
    return expr


def with_scorecard(df: DataFrame, intercept: float) -> DataFrame:
    """MTH-2: add ``log_odds`` and ``denial_prob``."""
    lo = scorecard_log_odds(intercept)
    return df.withColumn("log_odds", lo).withColumn("denial_prob", sigmoid(F.col("log_odds")))


def with_denial_label(df: DataFrame, intercept: float, seed: int = K.LABEL_SEED) -> DataFrame:
    """MTH-3: ``denial_label = u < p`` with ``u`` hashed from the claim id."""
    scored = with_scorecard(df, intercept)
    u = hash_uniform(F.col("claim_id"), seed)
    return (scored.withColumn("denial_label", (u < F.col("denial_prob")).cast("int"))
                  .drop("log_odds"))


def label_summary(features: DataFrame) -> DataFrame:
    """AGG-4: one row with overall rate, counts, and rates by prior auth."""
    lab = F.col("denial_label")
    pa = F.col("prior_auth_present")
    return features.agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.avg(lab.cast("double")).alias("denial_rate"),
        F.sum(lab).alias("n_denied"),
        F.sum((lab == 0).cast("int")).alias("n_approved"),
        F.sum((pa == 0).cast("int")).alias("n_no_auth"),
        F.avg(F.when(pa == 0, lab.cast("double"))).alias("denial_rate_no_auth"),
        F.sum((pa == 1).cast("int")).alias("n_with_auth"),
        F.avg(F.when(pa == 1, lab.cast("double"))).alias("denial_rate_with_auth"),
    )


def denial_rate_by_prior_auth(features: DataFrame) -> DataFrame:
    """Flagship: denial rate and counts per (claim type, prior auth)."""
    return (features.groupBy("claim_type", "prior_auth_present")
                    .agg(F.count(F.lit(1)).alias("n_claims"),
                         F.sum("denial_label").alias("n_denied"),
                         F.round(F.avg(F.col("denial_label").cast("double")), 6).alias("denial_rate"),
                         F.round(F.avg("denial_prob"), 6).alias("mean_prob")))
