"""Loading raw claim files of several samples by their own headers."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from claimspark.plans import catalog as C
from claimspark.sources import samples as S

BENE = "DE1_0_2008_Beneficiary_Summary_File_Sample_{}.csv"
IP = "DE1_0_2008_to_2010_Inpatient_Claims_Sample_{}.csv"
OP = "DE1_0_2008_to_2010_Outpatient_Claims_Sample_{}.csv"


def put(folder, name, *lines):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def zipped(folder, name, member, *lines):
    with zipfile.ZipFile(os.path.join(folder, name), "w") as zf:
        zf.writestr(member, "\n".join(lines) + "\n")


def claim(k, date="20080101"):
    return f"b{k},c{k},{date}"


HEAD = "DESYNPUF_ID,CLM_ID,CLM_FROM_DT"


@pytest.mark.parametrize("kind, name, want", [
    ("IP", IP.format(1), (0, 1)), ("IP", IP.format(11), (0, 11)), ("IP", IP.format(1).replace(".csv", ".zip"), (1, 1)),
    ("IP", "Inpatient_7.csv", (2, 7)), ("IP", "Inpatient_17.zip", (3, 17)), ("IP", "inpatient-3-old.csv", (4, 3)), ("IP", OP.format(1), None),
    ("OP", OP.format(2) + "/part-00000.csv", (0, 2)), ("BENE", BENE.format(3), (0, 3)), ("BENE", "Beneficiary4.csv", (2, 4)), ("BENE", "notes.csv", None)])
def test_place(spark, kind, name, want):
    at = spark.createDataFrame([(f"file:/data 2008/in/{name}",)], "path string").select(S.place(F.col("path"), kind).alias("at")).first().at
    assert (at and (at.priority, at.sample_num)) == want


def test_one_data_set_for_each_sample_csv_before_zip(spark, tmp_path):
    d = str(tmp_path)
    put(d, IP.format(1), HEAD, claim(1))
    zipped(d, IP.format(1).replace(".csv", ".zip"), "x.csv", HEAD, claim(2))
    put(d, "Inpatient_1.csv", HEAD, claim(3))
    put(d, IP.format(11), HEAD, claim(4))
    put(d, "Inpatient_5.csv", HEAD, claim(5))
    put(d, f"{OP.format(1)}/part-0.csv", HEAD, claim(6))
    put(d, f"{OP.format(1)}/part-1.csv", HEAD, claim(7))
    got = sorted((r.kind, r.sample_num, r.form, os.path.basename(r.path)) for r in S.discover(spark, d, [1, 5, 9]).collect())
    assert got == [("IP", 1, "csv", IP.format(1)), ("IP", 5, "csv", "Inpatient_5.csv"), ("OP", 1, "csv", "part-0.csv"), ("OP", 1, "csv", "part-1.csv")]
    assert {r.sample_num for r in S.discover(spark, d).collect()} == {1, 5, 11}


def test_parts_with_their_own_headers_load_by_name(spark, tmp_path):
    d = str(tmp_path)
    put(d, f"{OP.format(1)}/part-0.csv", HEAD, claim(1), claim(2))
    put(d, f"{OP.format(1)}/part-1.csv", '﻿CLM_FROM_DT,"CLM_ID", DESYNPUF_ID,UNKNOWN', '20080203,c3,b3,"x, y"')
    put(d, f"{OP.format(1)}/part-2.csv", "HCPCS_CD_1,CLM_ID,DESYNPUF_ID", "99213,c4,b1")
    put(d, BENE.format(1), "BENE_BIRTH_DT,DESYNPUF_ID", "19300101,b1", "19400101,b3")
    staged = S.stage(spark, d, [1])
    assert {r.status for r in S.sample_status(spark, staged, [1]).collect() if r.kind != "IP"} == {"loaded"}
    got = {r.claim_id: (r.bene_id, str(r.CLM_FROM_DT), r.HCPCS_CD_1, str(r.BENE_BIRTH_DT)) for r in S.load(spark, staged, [1]).collect()}
    assert got == {"c1": ("b1", "2008-01-01", None, "1930-01-01"), "c2": ("b2", "2008-01-01", None, "None"),
                   "c3": ("b3", "2008-02-03", None, "1940-01-01"), "c4": ("b1", "None", "99213", "1930-01-01")}


def test_a_sample_fails_alone(spark, tmp_path):
    d = str(tmp_path)
    for n in (1, 2, 3, 4, 5, 6):
        put(d, OP.format(n), HEAD, claim(n))
        if n != 2:
            put(d, BENE.format(n), "DESYNPUF_ID", f"b{n}")
    put(d, OP.format(3), HEAD, claim(3), "b3,c33")  # too few fields
    put(d, IP.format(4), "CLM_ID,CLM_FROM_DT", "c44,20080101")  # a header without its key is none
    put(d, IP.format(5), "DESYNPUF_ID,CLM_ID,SEGMENT", "b5,c5,1", "b5,c55,2")
    with open(os.path.join(d, IP.format(6).replace(".csv", ".zip")), "wb") as f:
        f.write(b"no archive")
    wanted = [1, 2, 3, 4, 5, 6, 7]
    staged = S.stage(spark, d, wanted)
    status = {(r.sample_num, r.kind): r for r in S.sample_status(spark, staged, wanted).collect()}
    assert {n for (n, _), r in status.items() if r.sample_loaded} == {1, 5}
    assert status[2, "BENE"].status == "missing" and status[7, "OP"].reason == "no file"
    assert status[3, "OP"].n_bad == 1 and status[3, "OP"].status == "failed"
    assert status[4, "IP"].reason == "columns not found: CLM_ID, DESYNPUF_ID"
    assert status[6, "IP"].status == "failed" and status[1, "IP"].status == "missing"
    assert sorted((r.sample_num, r.claim_type, r.claim_id) for r in S.load(spark, staged, wanted).collect()) == [(1, "OP", "c1"), (5, "IP", "c5"), (5, "OP", "c5")]


def test_archives_load_where_there_is_no_csv(spark, tmp_path):
    d = str(tmp_path)
    zipped(d, OP.format(1).replace(".csv", ".zip"), "a.csv", HEAD, claim(1), claim(2))
    zipped(d, BENE.format(1).replace(".csv", ".zip"), "b.csv", "DESYNPUF_ID", "b1")
    staged = S.stage(spark, d)
    assert sorted(r.claim_id for r in S.load(spark, staged).collect()) == ["c1", "c2"]


def test_nothing_to_load_is_an_error(spark, tmp_path):
    put(str(tmp_path), BENE.format(1), "DESYNPUF_ID", "b1")
    with pytest.raises(RuntimeError, match="sample 1 IP: no file"):
        S.load(spark, S.stage(spark, str(tmp_path), [1]), [1])


def test_surplus_fields_are_marked(spark, tmp_path):
    """Also where the last columns are not wanted."""
    d = str(tmp_path)
    put(d, OP.format(1), HEAD + ",OTHER", claim(1) + ",x", claim(2) + ",x,y")
    put(d, BENE.format(1), "DESYNPUF_ID", "b1")
    staged = S.stage(spark, d, [1])
    assert [r[0] for r in staged.tables["OP"].orderBy("CLM_ID").select(S.BAD).collect()] == [False, True]


def test_raw_files_derive_the_claims_once(spark, sf_small, monkeypatch):
    """Each file's rows come from the table written once: no file joins and ranks the order lines again."""
    plans, write = [], C._write_csv
    monkeypatch.setattr(C, "_write_csv", lambda df, path: (plans.append((path, df._jdf.queryExecution().toString())), write(df, path)))
    root = C.stage_raw_files(spark, sf_small)
    claims = [plan for path, plan in plans if "Claims" in path]
    assert len(claims) == 6 and not any("Window" in plan or "Join" in plan for plan in claims)
    raw = C.FX.raw_claims(spark, sf_small)
    n = sum(spark.read.option("header", True).csv(f"{root}/{C._FILES[kind].format(s)}").filter("CLM_ID <> 'short'").count() for kind in ("IP", "OP") for s in (1, 2, 3))
    assert n == raw.count()
