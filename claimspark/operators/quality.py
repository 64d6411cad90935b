"""Data-quality rules (DQ-1 claim validation, DQ-2 override validation, DQ-3).

Violations are computed as an array column in one projection, so validating
and splitting valid rows from quarantine costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

# fixed values: claim-input ranges (field, low, high); None = unbounded
_BINARY = ["is_inpatient", "has_primary_payer", "is_adjustment", "prior_auth_present", "has_op_surgeon",
           "has_procedure", "has_hcpcs", "bene_esrd", "bene_is_deceased", *K.CHRONIC_FEATURES]
CLAIM_RULES = (
    [(c, 0, 1) for c in _BINARY]
    + [("los_days", 0, None), ("claim_month", 1, 12), ("num_diagnoses", 0, None),
       ("num_procedures", 0, None), ("bene_age", 0, 120), ("bene_hi_mons", 0, 12),
       ("bene_hmo_mons", 0, 12), ("chronic_count", 0, None)]
)
RULE_NAMES = [f"{c}_range" for c, _, _ in CLAIM_RULES]


def _out_of_range(c: str, lo, hi) -> Column:
    x = F.col(c)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (x < lo)
    if hi is not None:
        bad = bad | (x > hi)
    # an absent (null) field takes its default, which is always in range
    return x.isNotNull() & bad


def with_claim_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` (comma list in rule order, '' if none) and ``is_valid``."""
    arr = F.array_compact(F.array(*[F.when(_out_of_range(c, lo, hi), F.lit(f"{c}_range"))
                                    for c, lo, hi in CLAIM_RULES]))
    return (df.withColumn("violations", F.array_join(arr, ","))
              .withColumn("is_valid", F.size(arr) == 0))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_claim_violations(df)
    return checked.filter("is_valid"), checked.filter(~F.col("is_valid"))


def with_override_violations(df: DataFrame, decision_col: str = "final_decision",
                             reason_col: str = "override_reason") -> DataFrame:
    """DQ-2: decision must be APPROVE|DENY, reason at least 5 characters."""
    bad_decision = F.coalesce(~F.col(decision_col).rlike("^(" + "|".join(K.OVERRIDE_DECISIONS) + ")$"),
                              F.lit(True))
    bad_reason = F.coalesce(F.length(reason_col) < K.OVERRIDE_REASON_MIN_LEN, F.lit(True))
    arr = F.array_compact(F.array(F.when(bad_decision, F.lit("decision")),
                                  F.when(bad_reason, F.lit("reason_too_short"))))
    return (df.withColumn("violations", F.array_join(arr, ","))
              .withColumn("is_valid", F.size(arr) == 0))


def clean_claim_input(df: DataFrame) -> DataFrame:
    """DQ-3: 0 in code/DRG/utilisation fields means missing; recount chronic."""
    fixes = {c: F.nullif(F.col(c), F.lit(0)) for c in ("primary_icd9_num", "drg_num", "utlztn_days")}
    fixes["chronic_count"] = sum(F.coalesce(F.col(c), F.lit(0)) for c in K.CHRONIC_FEATURES)
    return df.withColumns(fixes)
