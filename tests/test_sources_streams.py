"""File sources (CSV, ZIP, survey) and streams equal the batch results."""
import io
import os
import tempfile
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimspark import constants as K
from claimspark.operators import audit as AU
from claimspark.plans import catalog as C
from claimspark.plans import pipeline as P
from claimspark.sources import files as SRC
from claimspark.sources import fixtures as FX


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_csv_ingest_has_the_claims_of_good_samples(spark, sf_small):
    got = C.QUERIES["csv_ingest"](spark, sf_small)
    want = P.claims_raw(spark, sf_small).filter(F.col("claim_id").cast("long") % 10 != 9)
    same = [c for c in want.columns if c not in ("sample_num", *sum(C._LACKING.values(), []))]
    assert _same(got.select(same), want.select(same))
    assert _same(got.filter("sample_num = 1"), want.filter(F.col("claim_id").cast("long") % 2 == 0))


def test_zip_member_reader(spark, sf_small):
    d = tempfile.mkdtemp(prefix="claimspark-zip-", dir="/tmp")
    raw = FX.raw_claims(spark, sf_small).filter(F.col("claim_type") == "OP")
    pdf = raw.select(*[c for c in K.OP_COLS if c in raw.columns]).toPandas()
    buf = io.StringIO()
    pdf.to_csv(buf, index=False)
    with zipfile.ZipFile(os.path.join(d, "DE1_Outpatient_Claims_Sample_1.zip"), "w") as zf:
        zf.writestr("readme.txt", "not the data")
        zf.writestr("DE1_Outpatient_Claims_Sample_1.csv", buf.getvalue())
    got = SRC.read_zip_csv(spark, os.path.join(d, "*.zip"), K.OP_COLS)
    assert got.count() == len(pdf)
    assert got.select("sample_num").distinct().collect()[0][0] == 1
    # same cleaned rows as the CSV route
    from claimspark.operators.ingest import clean_claims
    a = clean_claims(got, kind="OP").drop("sample_num")
    b = P.clean_claims(spark, sf_small).filter(F.col("claim_type") == "OP")
    assert _same(a, b)


def test_survey_fallback(spark, sf_small):
    assert SRC.survey_rates_from_path(spark, None).first().source == "meps_literature"
    d = tempfile.mkdtemp(prefix="claimspark-survey-", dir="/tmp")
    FX.raw_survey(spark, sf_small).drop("UNABL42", "DELAY42", "NOPROB42").write.option("header", True).csv(d + "/s")
    assert SRC.survey_rates_from_path(spark, d + "/s").first().source == "meps_literature_no_indicator"
    FX.raw_survey(spark, sf_small).write.option("header", True).csv(d + "/t")
    got = SRC.survey_rates_from_path(spark, d + "/t")
    assert _same(got, P.survey_rates(spark, sf_small))


def test_stream_equals_batch(spark, sf_small):
    got = C.QUERIES["stream_scores"](spark, sf_small)
    want = C.QUERIES["risk_levels"](spark, sf_small)
    assert _same(got, want)


def test_audit_stream_dedups_redelivery(spark, sf_small):
    got = C.QUERIES["stream_audit"](spark, sf_small)
    assert got.count() == got.select("audit_id").distinct().count()
    valid = FX.raw_overrides(spark, sf_small).filter(F.col("final_decision").isin("APPROVE", "DENY")
                                                     & (F.length("override_reason") >= 5))
    assert got.count() == valid.count()


def test_audit_stream_keeps_a_year_in_any_order(spark, sf_small, tmp_path):
    from claimspark.streaming import streams as ST

    ov = FX.raw_overrides(spark, sf_small).filter(F.col("final_decision").isin("APPROVE", "DENY") & (F.length("override_reason") >= 5))
    ov = spark.createDataFrame(ov.orderBy("audit_id").limit(24).collect(), ov.schema)
    months = [7, 0, 11, 3, 9, 1, 5, 10, 2, 8, 4, 6]
    stamp = F.date_format(F.add_months(F.lit("2008-01-15").cast("date"), F.pmod(F.col("n"), F.lit(12))), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = ov.withColumn("n", F.row_number().over(Window.orderBy("audit_id")) - 1)
    year = rows.withColumn("timestamp", stamp.cast(ov.schema["timestamp"].dataType)).cache()
    for k, month in enumerate([*months, *months[::-1]]):  # every file is delivered twice
        year.filter(F.pmod("n", F.lit(12)) == month).drop("n").coalesce(1).write.parquet(f"{tmp_path}/in/file={k:02}")
    stream = spark.readStream.schema(ov.schema).option("maxFilesPerTrigger", 6).parquet(f"{tmp_path}/in/*")
    ST.run_audit(ST.audit_entries(stream), f"{tmp_path}/log", f"{tmp_path}/ck")
    got = AU.read_log(spark, f"{tmp_path}/log")
    assert sorted(r.audit_id for r in got.collect()) == sorted(r.audit_id for r in year.collect())
