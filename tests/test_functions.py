"""Hand tables for the cleaning and decision column functions."""
import datetime as dt

from pyspark.sql import functions as F

from claimspark.functions.cleaning import clean_npi, icd9_prefix, null_token, yyyymmdd_date
from claimspark.operators.metrics import decisions
from claimspark.operators.shap import direction
from claimspark.operators.survey import age_group, insurance_type


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_dates(spark):
    got = one_col(spark, ["20080115", "0", "00000000", "", "20081315", None, " 20080115 "], yyyymmdd_date)
    assert got == [dt.date(2008, 1, 15), None, None, None, None, None, dt.date(2008, 1, 15)]


def test_npi(spark):
    got = one_col(spark, [" 123.0 ", "0", "0.0", "", " ", "00", None, "12.05"], clean_npi)
    assert got == ["123", None, None, None, None, "00", None, "12.05"]


def test_icd9_strict(spark):
    got = one_col(spark, ["V090", "E8120", "25000", "v090", "X12", None, "25.", "4019", " 25"], icd9_prefix)
    assert got == [900, 950, 250, None, None, None, None, 401, None]


def test_icd9_normalised(spark):
    got = one_col(spark, [" v090 ", "", " ", "e850", "4019"], lambda c: icd9_prefix(c, normalise=True))
    assert got == [900, None, None, 950, 401]


def test_null_tokens(spark):
    assert one_col(spark, ["", " ", "NA", "  ", "x"], null_token) == [None, None, None, "  ", "x"]


def test_age(spark):
    df = spark.createDataFrame([(dt.date(1936, 1, 1), dt.date(2008, 1, 1)), (dt.date(2008, 1, 1), dt.date(2007, 6, 1))],
                               "b date, s date")
    got = [r[0] for r in df.select((F.datediff("s", "b") / 365.25).cast("int")).collect()]
    assert got == [72, 0]  # 26,298 days -> 72; service before birth truncates toward zero


def test_age_band(spark):
    got = one_col(spark, [-1.0, 0.0, 17.0, 17.5, 64.0, 65.0, 1000.0], age_group, "double")
    assert got == ["unknown", "0-17", "0-17", "18-44", "45-64", "65+", "unknown"]


def test_insurance(spark):
    assert one_col(spark, [1.0, 2.0, 3.0, 0.0, None], insurance_type, "double") == \
        ["private", "public", "uninsured", "unknown", "unknown"]


def test_chronic_flag_and_count(spark):
    from claimspark.operators.features import feat_chronic
    from claimspark import constants as K
    cols = [s for s, _ in K.CHRONIC_SOURCE_COLS]
    rows = [tuple([1, 2, None] + [2] * (len(cols) - 3))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    r = feat_chronic(df).first()
    assert (r["has_alzheimer"], r["has_chf"], r["has_ckd"], r["chronic_count"]) == (1, 0, None, 1)


def test_decisions(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.4,), (0.7,), (0.39,)], "prediction_prob double")
    got = [(r.recommended_action, r.denial_risk_level) for r in decisions(df).collect()]
    assert got == [("APPROVE", "MEDIUM"), ("DENY", "MEDIUM"), ("APPROVE", "MEDIUM"), ("DENY", "HIGH"),
                   ("APPROVE", "LOW")]


def test_direction(spark):
    assert one_col(spark, [0.0, 0.1, -0.1], direction, "double") == \
        ["decreases_denial", "increases_denial", "decreases_denial"]
