"""Numbers and attribution rows of letters: as Java's formatter prints them, constants where the attribution is zero; stage tables written without a sort."""
import math

import pytest
from pyspark.sql import functions as F

from claimspark.operators import report as RP
from claimspark.plans import pipeline as P

VALUES = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e-5, -1e-5, 5e-5, -5e-5, 1.00005, 0.35, -2.5, 99999999999999.9, 1e14, -1e18, 123456789012.34567]


def test_numbers_as_the_formatter_prints_them(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double")
    v = F.col("v")
    got = df.select(RP.pct1(v), F.format_string("%.1f%%", F.round(v * 100, 1)), RP.signed4(v), F.format_string("%+.4f", F.round(v, 4)),
                    RP.fixed(v, 4), F.format_string("%.4f", F.round(v, 4))).collect()
    for r in got:
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5], r


def test_attribution_rows(spark):
    rows = [(v, f) for v in VALUES for f in ("clm_pmt_amt", "no such feature", None)]
    df = spark.createDataFrame(rows, "value double, feature string")
    v = F.col("value")
    old = F.format_string("  %s%.4f  %-25s  %s", F.when(v > 0, "+").otherwise("-"), F.round(F.abs(v), 4), F.col("feature"),
                          F.repeat(F.lit("#"), F.least(F.abs(v) * 40, F.lit(30.0)).cast("int")))
    finite = df.filter("NOT isnan(value)")
    got = finite.select(RP.shap_rows(F.array(F.struct("value", "feature"))), old).filter(v.isNotNull()).collect()
    assert len(got) == 3 * sum(x is not None and not math.isnan(x) for x in VALUES)
    for new, before in got:
        assert new == before


@pytest.mark.parametrize("number, member", [("5", "MBR-0000005"), ("-5", "MBR--000005"), ("0", "MBR-0000000"), ("123456789012", "MBR-123456789012"), ("A-17", "MBR-A-17")])
def test_ids(spark, number, member):
    assert spark.createDataFrame([(number,)], "i string").select(RP.member_id_col(F.col("i"))).first()[0] == member


def test_stage_settings_hold_while_a_stage_is_written(spark):
    seen = {}

    def build():
        seen.update({k: spark.conf.get(k, None) for k in P.STAGE_SETTINGS})
        return spark.range(40).select("id", (F.col("id") % 20).cast("int").alias("sample_num"))

    before = {k: spark.conf.get(k, None) for k in P.STAGE_SETTINGS}
    got = P.materialized(spark, "test-stage-settings", "some_stage", build)
    assert seen == P.STAGE_SETTINGS and {k: spark.conf.get(k, None) for k in P.STAGE_SETTINGS} == before
    assert sorted(r.id for r in got.collect()) == list(range(40)) and all(r.id % 20 == r.sample_num for r in got.collect())
