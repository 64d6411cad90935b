"""Feature stages (PRJ-1, DT-2..4, COND-1..5, ARR-1, CAST-1/2).

Each stage is a ``DataFrame -> DataFrame`` function chained with
``transform``; Catalyst fuses the chain into one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHRONIC_FEATURES, CHRONIC_SOURCE_COLS, FEATURE_COLS, ID_COLS
from ..functions.cleaning import coded_flag, icd9_prefix, present


def feat_temporal(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "los_days": F.datediff("CLM_THRU_DT", "CLM_FROM_DT"),
        "claim_year": F.year("CLM_FROM_DT"),
        "claim_month": F.month("CLM_FROM_DT"),
    })


def feat_amounts(df: DataFrame) -> DataFrame:
    pay = F.coalesce(F.col("CLM_PMT_AMT"), F.lit(0.0))
    prim = F.coalesce(F.col("NCH_PRMRY_PYR_CLM_PD_AMT"), F.lit(0.0))
    # negatives are adjustments; kept unclipped because the label needs <= 0
    return df.withColumns({
        "clm_pmt_amt": pay,
        "primary_payer_amt": prim,
        "is_adjustment": (pay < 0).cast("int"),
        "has_primary_payer": (prim > 0).cast("int"),
    })


def feat_provider(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "prior_auth_present": present("AT_PHYSN_NPI"),
        "has_op_surgeon": present("OP_PHYSN_NPI"),
    })


def feat_diagnosis(df: DataFrame) -> DataFrame:
    dx = ["ICD9_DGNS_CD_1", "ICD9_DGNS_CD_2", "ICD9_DGNS_CD_3"]
    prc = ["ICD9_PRCDR_CD_1", "ICD9_PRCDR_CD_2"]
    # admitting code when present (even if unparseable), else the first code
    primary = (F.when(F.col("ADMTNG_ICD9_DGNS_CD").isNotNull(), icd9_prefix("ADMTNG_ICD9_DGNS_CD"))
                .otherwise(icd9_prefix("ICD9_DGNS_CD_1")))
    return df.withColumns({
        "primary_icd9_num": primary,
        "num_diagnoses": sum(present(c) for c in dx),
        "num_procedures": sum(present(c) for c in prc),
        "has_procedure": present("ICD9_PRCDR_CD_1"),
        "has_hcpcs": present("HCPCS_CD_1"),
        "drg_num": F.col("CLM_DRG_CD").try_cast("int"),
        "utlztn_days": F.col("CLM_UTLZTN_DAY_CNT").try_cast("int"),
    })


def feat_demographics(df: DataFrame) -> DataFrame:
    # days / 365.25 truncated toward zero (a cast, not floor)
    age = (F.datediff("CLM_FROM_DT", "BENE_BIRTH_DT") / F.lit(365.25)).cast("int")
    return df.withColumns({
        "bene_age": age,
        "bene_sex": F.col("BENE_SEX_IDENT_CD").cast("int"),
        "bene_race": F.col("BENE_RACE_CD").cast("int"),
        "bene_esrd": F.col("BENE_ESRD_IND").cast("int"),
        "bene_hi_mons": F.col("BENE_HI_CVRAGE_TOT_MONS").try_cast("int"),
        "bene_hmo_mons": F.col("BENE_HMO_CVRAGE_TOT_MONS").try_cast("int"),
        "bene_is_deceased": present("BENE_DEATH_DT"),
    })


def feat_chronic(df: DataFrame) -> DataFrame:
    df = df.withColumns({dst: coded_flag(src) for src, dst in CHRONIC_SOURCE_COLS})
    # horizontal sum: a null flag adds 0
    count = sum(F.coalesce(F.col(c), F.lit(0)) for c in CHRONIC_FEATURES)
    return df.withColumn("chronic_count", count)


def feat_claim_type(df: DataFrame) -> DataFrame:
    return df.withColumn("is_inpatient", (F.col("claim_type") == F.lit("IP")).cast("int"))


STAGES = [feat_temporal, feat_amounts, feat_provider, feat_diagnosis,
          feat_demographics, feat_chronic, feat_claim_type]


def build_features(claims_raw: DataFrame) -> DataFrame:
    """All seven stages, then the ordered 4 ids + 36 features projection."""
    df = claims_raw
    for stage in STAGES:
        df = df.transform(stage)
    return df.select(*ID_COLS, *FEATURE_COLS)
