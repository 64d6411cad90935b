"""Raw claim and beneficiary cleaning, segment filter, union and join.

SRC-4 (schema drift), PRJ-2, PRJ-4, FLT-1, JOIN-1, SET-1, DT-1, STR-1, STR-2,
CAST-1. Everything is a projection or a filter over the input, so the whole
cleaning step is one narrow stage; only the beneficiary join shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (AMOUNT_COLS, BENE_COLS, CHRONIC_SOURCE_COLS, CLAIM_DATE_COLS,
                         IP_COLS, NPI_COLS, OP_COLS)
from ..functions.cleaning import clean_npi, null_token, yes_flag, yyyymmdd_date

# Cleaned claim columns: inpatient list, then the outpatient-only ones.
_CLAIM_RAW_ORDER = [c for c in IP_COLS if c != "SEGMENT"] + [c for c in OP_COLS if c not in IP_COLS]


def _claim_type_of(col: str) -> T.DataType:
    if col in CLAIM_DATE_COLS:
        return T.DateType()
    if col in AMOUNT_COLS:
        return T.DoubleType()
    return T.StringType()


def _bene_type_of(col: str) -> T.DataType:
    if col in ("BENE_BIRTH_DT", "BENE_DEATH_DT"):
        return T.DateType()
    if col == "BENE_ESRD_IND":
        return T.BooleanType()
    if col == "DESYNPUF_ID":
        return T.StringType()
    return T.IntegerType()


CLAIM_COLUMNS = (["bene_id", "claim_id"] + [c for c in _CLAIM_RAW_ORDER if c not in ("DESYNPUF_ID", "CLM_ID")]
                 + ["claim_type"])
BENE_COLUMNS = ["bene_id"] + [c for c in BENE_COLS if c != "DESYNPUF_ID"]


def _carry(df: DataFrame) -> list[str]:
    """Columns kept through cleaning when present (the file's sample number)."""
    return ["sample_num"] if "sample_num" in df.columns else []


def apply_null_tokens(df: DataFrame) -> DataFrame:
    """Exact raw tokens '', ' ', 'NA' -> null on every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    return df.withColumns({c: null_token(c) for c in strings})


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns a file lacks (schema-drift report, SRC-4)."""
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def conform(df: DataFrame, wanted: list[str], type_of) -> DataFrame:
    """Select the wanted columns in order; absent ones become typed nulls."""
    have = set(df.columns)
    return df.select([F.col(c) if c in have else F.lit(None).cast(type_of(c)).alias(c) for c in wanted])


def segment_filter(df: DataFrame) -> DataFrame:
    """FLT-1: keep inpatient segment 1 (trimmed text '1'); null segment drops.

    Rows that carry no SEGMENT column at all (outpatient files) are kept, so
    a mixed input keeps every outpatient row.
    """
    seg_one = F.trim(F.col("SEGMENT").cast("string")) == F.lit("1")
    if "claim_type" in df.columns:
        keep = (F.col("claim_type") == F.lit("OP")) | seg_one
    else:
        keep = seg_one
    return df.filter(keep).drop("SEGMENT")


def clean_claims(raw: DataFrame, kind: str | None = None) -> DataFrame:
    """Raw claim text -> typed claim rows with a fixed schema.

    ``kind`` is 'IP' or 'OP' for a single-kind file; ``None`` when the input
    already carries ``claim_type`` (mixed adapter input).
    """
    df = apply_null_tokens(raw)
    if kind is not None:
        df = df.withColumn("claim_type", F.lit(kind))
    if "SEGMENT" in df.columns:
        df = segment_filter(df)
    fixes = {}
    for c in CLAIM_DATE_COLS:
        if c in df.columns:
            fixes[c] = yyyymmdd_date(c)
    for c in NPI_COLS:
        if c in df.columns:
            fixes[c] = clean_npi(c)
    for c in AMOUNT_COLS:
        if c in df.columns:
            fixes[c] = F.col(c).try_cast("double")
    df = df.withColumns(fixes).withColumnsRenamed({"DESYNPUF_ID": "bene_id", "CLM_ID": "claim_id"})
    return conform(df, CLAIM_COLUMNS + _carry(df), _claim_type_of)


def clean_bene(raw: DataFrame) -> DataFrame:
    df = apply_null_tokens(raw)
    fixes = {c: yyyymmdd_date(c) for c in ("BENE_BIRTH_DT", "BENE_DEATH_DT") if c in df.columns}
    if "BENE_ESRD_IND" in df.columns:
        fixes["BENE_ESRD_IND"] = yes_flag("BENE_ESRD_IND")
    # coded integers: strict for sex/race (bad codes are errors), lenient otherwise
    for c in ("BENE_SEX_IDENT_CD", "BENE_RACE_CD"):
        if c in df.columns:
            fixes[c] = F.col(c).cast("int")
    for c in [s for s, _ in CHRONIC_SOURCE_COLS] + ["BENE_HI_CVRAGE_TOT_MONS", "BENE_SMI_CVRAGE_TOT_MONS",
                                                   "BENE_HMO_CVRAGE_TOT_MONS"]:
        if c in df.columns:
            fixes[c] = F.col(c).try_cast("int")
    df = df.withColumns(fixes).withColumnsRenamed({"DESYNPUF_ID": "bene_id"})
    return conform(df, BENE_COLUMNS + _carry(df), _bene_type_of)


def union_claims(frames: list[DataFrame]) -> DataFrame:
    """SET-1: union by name; a column one side lacks becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_beneficiaries(claims: DataFrame, bene: DataFrame, sample_num: int | None = None) -> DataFrame:
    """JOIN-1: claims left-join beneficiaries within one sample.

    No broadcast hint: the beneficiary table grows with the data, so the
    choice is left to AQE's runtime size check (it broadcasts when the
    shuffled side is measured small, else sort-merge, splitting a hot
    bene_id partition with skew-join handling).
    """
    if sample_num is not None:
        claims = claims.withColumn("sample_num", F.lit(sample_num))
        bene = bene.withColumn("sample_num", F.lit(sample_num))
    return claims.join(bene, on=["sample_num", "bene_id"], how="left")


CLAIMS_RAW_COLUMNS = (CLAIM_COLUMNS[:-1] + [c for c in BENE_COLUMNS if c != "bene_id"]
                      + ["claim_type", "sample_num"])


def claims_raw(raw_claims: DataFrame, raw_bene: DataFrame, sample_num: int = 1) -> DataFrame:
    """The 45-column ``claims_raw`` table: clean, filter, join, tag."""
    joined = join_beneficiaries(clean_claims(raw_claims), clean_bene(raw_bene), sample_num)
    return joined.select(*CLAIMS_RAW_COLUMNS)
