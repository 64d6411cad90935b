"""Survey denial rates (SRC-6..9, FLT-4, COND-6..8, AGG-1, CAST-3).

A survey file gives rates per age group x insurance type; when the file is
absent or has no usable indicator, the published literature table is used
and the reason is recorded in ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (INSURANCE_CODES, LITERATURE_RATES, SURVEY_AGE_CANDIDATES,
                         SURVEY_DENIAL_CANDIDATES, SURVEY_INSCOV_CANDIDATES)

RATE_SCHEMA = "age_group string, insurance_type string, denial_rate double, n int, source string"


def first_available(columns: list[str], candidates: list[str]) -> str | None:
    """SRC-7: first candidate name the file has (plan-time choice)."""
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def upper_columns(df: DataFrame) -> DataFrame:
    """SRC-6: survey column names are matched upper-case."""
    return df.toDF(*[c.upper() for c in df.columns])


def age_group(age) -> F.Column:
    """COND-6: (-1,17] (17,44] (44,64] (64,999]; outside -> 'unknown'."""
    return (F.when((age > -1) & (age <= 17), "0-17")
             .when((age > 17) & (age <= 44), "18-44")
             .when((age > 44) & (age <= 64), "45-64")
             .when((age > 64) & (age <= 999), "65+")
             .otherwise("unknown"))


def insurance_type(code) -> F.Column:
    """COND-7: 1/2/3 -> private/public/uninsured, anything else 'unknown'."""
    expr = F.lit("unknown")
    for k, v in sorted(INSURANCE_CODES.items(), reverse=True):
        expr = F.when(code == k, v).otherwise(expr)
    return expr


def literature_rates(spark: SparkSession, source: str = "meps_literature") -> DataFrame:
    rows = [(a, i, r, 0, source) for a, i, r in LITERATURE_RATES]
    return spark.createDataFrame(rows, RATE_SCHEMA)


def survey_rates(spark: SparkSession, survey: DataFrame | None,
                 exclude: tuple[str, ...] = ()) -> DataFrame:
    """AGG-1 over a survey frame, with the literature fallback (SRC-9).

    ``exclude`` drops indicator names (for example the inverse NOPROB ones);
    by default the reference list is used unchanged so rates match.
    """
    if survey is None:
        return literature_rates(spark)
    survey = upper_columns(survey)
    age_col = first_available(survey.columns, SURVEY_AGE_CANDIDATES)
    ins_col = first_available(survey.columns, SURVEY_INSCOV_CANDIDATES)
    denial_cols = [c for c in SURVEY_DENIAL_CANDIDATES if c in survey.columns and c not in exclude]
    if age_col is None or ins_col is None or not denial_cols:
        return literature_rates(spark, "meps_literature")
    age = F.col(age_col).try_cast("double")
    ins = F.col(ins_col).try_cast("double")
    # COND-8: denied when any indicator equals 1; non-numeric counts as not 1
    denied = F.greatest(*[F.coalesce((F.col(c).try_cast("double") == 1).cast("int"), F.lit(0))
                          for c in denial_cols]) if len(denial_cols) > 1 else \
        F.coalesce((F.col(denial_cols[0]).try_cast("double") == 1).cast("int"), F.lit(0))
    rows = (survey
            .filter(F.col(age_col).isNotNull() & F.col(ins_col).isNotNull())  # FLT-4
            .select(age.alias("age"), ins.alias("ins"), denied.alias("denied"))
            .filter(F.col("age").isNotNull()))
    return (rows.groupBy(age_group(F.col("age")).alias("age_group"),
                         insurance_type(F.col("ins")).alias("insurance_type"))
                .agg(F.avg("denied").alias("denial_rate"), F.count(F.lit(1)).cast("int").alias("n"))
                .withColumn("source", F.lit("meps_file")))
