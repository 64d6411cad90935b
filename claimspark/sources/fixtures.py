"""Adapter: driver tables -> claims-shaped raw tables.

The driver data holds no claims, so these SQL texts derive them (one claim
per order, diagnosis codes from line ranks, beneficiaries from customers,
overrides from events). They plant the dirty values the cleaning operators
must handle. The same texts run in Spark and, as CTEs, in the DuckDB oracle:
they are fixture construction, not operators under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

RAW_CLAIMS_SQL = """
WITH ln AS (SELECT l_orderkey,l_partkey,l_suppkey,ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS rn FROM lineitem),
ag AS (SELECT l_orderkey,CAST(COUNT(*) AS INTEGER) AS n,MAX(CASE WHEN rn=1 THEN l_partkey END) AS p1,MAX(CASE WHEN rn=2 THEN l_partkey END) AS p2,MAX(CASE WHEN rn=3 THEN l_partkey END) AS p3,MAX(CASE WHEN rn=4 THEN l_partkey END) AS p4,MIN(l_suppkey) AS s1,MAX(l_suppkey) AS s2 FROM ln GROUP BY l_orderkey),
o AS (SELECT o_orderkey,o_custkey,CAST(o_orderdate AS DATE) AS d,o_totalprice,CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'IP' ELSE 'OP' END AS k,n,p1,p2,p3,p4,s1,s2,(o_totalprice-20000)/25 AS a FROM orders LEFT JOIN ag ON o_orderkey=l_orderkey)
SELECT CAST(o_custkey AS STRING) AS DESYNPUF_ID, CAST(o_orderkey AS STRING) AS CLM_ID, CASE WHEN k='IP' THEN CASE WHEN o_orderkey % 50 = 7 THEN '2' ELSE ' 1' END END AS SEGMENT, k AS claim_type,
 CASE WHEN o_orderkey % 211 = 5 THEN '00000000' ELSE CAST(YEAR(d)*10000+MONTH(d)*100+DAY(d) AS STRING) END AS CLM_FROM_DT, CAST(YEAR((d + (COALESCE(n,1)-1)))*10000+MONTH((d + (COALESCE(n,1)-1)))*100+DAY((d + (COALESCE(n,1)-1))) AS STRING) AS CLM_THRU_DT,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '0' WHEN o_orderkey % 10 = 2 THEN ' ' WHEN o_orderkey % 10 = 3 THEN CAST(s1 AS STRING) || '.0' ELSE ' ' || CAST(s1 AS STRING) END AS AT_PHYSN_NPI, CASE WHEN (o_orderkey+5) % 10 = 0 THEN NULL WHEN (o_orderkey+5) % 10 = 1 THEN '0' WHEN (o_orderkey+5) % 10 = 2 THEN ' ' WHEN (o_orderkey+5) % 10 = 3 THEN CAST(s2 AS STRING) || '.0' ELSE ' ' || CAST(s2 AS STRING) END AS OP_PHYSN_NPI,
 CASE WHEN o_orderkey % 83 = 2 THEN NULL ELSE CAST(ROUND(a,2) AS DOUBLE) END AS CLM_PMT_AMT, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS NCH_PRMRY_PYR_CLM_PD_AMT,
 CASE WHEN k='IP' THEN CAST(n AS STRING) END AS CLM_UTLZTN_DAY_CNT, CASE WHEN k='IP' THEN CASE WHEN o_orderkey % 37 = 1 THEN 'OTH' ELSE CAST(1 + p1 % 999 AS STRING) END END AS CLM_DRG_CD,
 CASE WHEN k='IP' THEN CASE WHEN p4 IS NULL THEN NULL WHEN p4 % 20 = 0 THEN 'V' || LPAD(CAST(p4 % 100 AS STRING),2,'0') WHEN p4 % 20 = 1 THEN 'E' || CAST(800 + p4 % 200 AS STRING) WHEN p4 % 20 = 2 THEN ' ' WHEN p4 % 20 = 3 THEN 'X12' ELSE LPAD(CAST(p4 % 1000 AS STRING),3,'0') || '9' END END AS ADMTNG_ICD9_DGNS_CD, CASE WHEN p1 IS NULL THEN NULL WHEN p1 % 20 = 0 THEN 'V' || LPAD(CAST(p1 % 100 AS STRING),2,'0') WHEN p1 % 20 = 1 THEN 'E' || CAST(800 + p1 % 200 AS STRING) WHEN p1 % 20 = 2 THEN ' ' WHEN p1 % 20 = 3 THEN 'X12' ELSE LPAD(CAST(p1 % 1000 AS STRING),3,'0') || '9' END AS ICD9_DGNS_CD_1, CASE WHEN p2 IS NULL THEN NULL WHEN p2 % 20 = 0 THEN 'V' || LPAD(CAST(p2 % 100 AS STRING),2,'0') WHEN p2 % 20 = 1 THEN 'E' || CAST(800 + p2 % 200 AS STRING) WHEN p2 % 20 = 2 THEN ' ' WHEN p2 % 20 = 3 THEN 'X12' ELSE LPAD(CAST(p2 % 1000 AS STRING),3,'0') || '9' END AS ICD9_DGNS_CD_2, CASE WHEN p3 IS NULL THEN NULL WHEN p3 % 20 = 0 THEN 'V' || LPAD(CAST(p3 % 100 AS STRING),2,'0') WHEN p3 % 20 = 1 THEN 'E' || CAST(800 + p3 % 200 AS STRING) WHEN p3 % 20 = 2 THEN ' ' WHEN p3 % 20 = 3 THEN 'X12' ELSE LPAD(CAST(p3 % 1000 AS STRING),3,'0') || '9' END AS ICD9_DGNS_CD_3,
 CASE WHEN n >= 4 THEN CAST(1000 + p2 % 8000 AS STRING) END AS ICD9_PRCDR_CD_1, CASE WHEN n >= 6 THEN CAST(1000 + p3 % 8000 AS STRING) END AS ICD9_PRCDR_CD_2,
 CASE WHEN k='OP' AND n >= 2 THEN CAST(90000 + p1 AS STRING) END AS HCPCS_CD_1 FROM o
"""

RAW_BENE_SQL = """
SELECT CAST(c_custkey AS STRING) AS DESYNPUF_ID, CAST(YEAR(b)*10000+MONTH(b)*100+DAY(b) AS STRING) AS BENE_BIRTH_DT, CASE WHEN c_custkey % 40 = 0 THEN '20011231' WHEN c_custkey % 2 = 0 THEN '0' END AS BENE_DEATH_DT, CAST(1 + c_custkey % 2 AS INTEGER) AS BENE_SEX_IDENT_CD, CAST(CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS INTEGER) AS BENE_RACE_CD, CASE WHEN c_custkey % 13 = 0 THEN 'Y' WHEN c_custkey % 13 = 1 THEN 'y' ELSE '0' END AS BENE_ESRD_IND,
CAST(CASE WHEN c_custkey % 7 = 0 THEN 6 ELSE 12 END AS INTEGER) AS BENE_HI_CVRAGE_TOT_MONS, CAST(CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 0 END AS INTEGER) AS BENE_HMO_CVRAGE_TOT_MONS,
 CAST(CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN (c_custkey + 0) % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_ALZHDMTA,
 CAST(CASE WHEN c_custkey % 29 = 1 THEN NULL WHEN (c_custkey + 1) % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_CHF,
 CAST(CASE WHEN c_custkey % 29 = 2 THEN NULL WHEN (c_custkey + 2) % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_CHRNKIDN,
 CAST(CASE WHEN c_custkey % 29 = 3 THEN NULL WHEN (c_custkey + 3) % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_CNCR,
 CAST(CASE WHEN c_custkey % 29 = 4 THEN NULL WHEN (c_custkey + 4) % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_COPD,
 CAST(CASE WHEN c_custkey % 29 = 5 THEN NULL WHEN (c_custkey + 5) % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_DEPRESSN,
 CAST(CASE WHEN c_custkey % 29 = 6 THEN NULL WHEN (c_custkey + 6) % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_DIABETES,
 CAST(CASE WHEN c_custkey % 29 = 7 THEN NULL WHEN (c_custkey + 7) % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_ISCHMCHT,
 CAST(CASE WHEN c_custkey % 29 = 8 THEN NULL WHEN (c_custkey + 8) % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_OSTEOPRS,
 CAST(CASE WHEN c_custkey % 29 = 9 THEN NULL WHEN (c_custkey + 9) % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_RA_OA,
 CAST(CASE WHEN c_custkey % 29 = 10 THEN NULL WHEN (c_custkey + 10) % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS SP_STRKETIA
FROM (SELECT *, DATE '1915-01-01' + CAST((c_custkey*37) % 18000 AS INTEGER) AS b FROM customer) x WHERE c_custkey % 97 <> 0
"""

RAW_SURVEY_SQL = """
SELECT CAST(c_custkey AS STRING) AS DUPERSID, CASE WHEN c_custkey % 53 = 0 THEN 'n/a' WHEN c_custkey % 47 = 0 THEN NULL ELSE CAST(c_custkey % 100 - 1 AS STRING) END AS AGELAST,
 CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS STRING) END AS INSCOVX, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS STRING) END AS UNABL42,
 CAST(1 + c_custkey % 7 AS STRING) AS DELAY42, CAST(1 + c_custkey % 11 AS STRING) AS NOPROB42 FROM customer
"""

RAW_OVERRIDES_SQL = """
SELECT CAST(event_id AS STRING) AS audit_id, CAST(event_id % 1500 AS STRING) AS claim_id, CAST(user_id AS STRING) AS member_id, 'ADJ-' || CAST(user_id % 20 AS STRING) AS adjuster_name,
 CASE WHEN value > 250 THEN 'DENY' ELSE 'APPROVE' END AS model_decision, ROUND(value / 500, 4) AS model_prob,
 CASE WHEN event_type IN ('purchase','click') THEN 'APPROVE' WHEN event_type IN ('error','view') THEN 'DENY' ELSE 'HOLD' END AS final_decision,
 CASE WHEN event_id % 9 = 0 THEN 'ok' WHEN event_id % 9 = 1 THEN NULL ELSE 'Reviewed against paper authorization log ' || props END AS override_reason, ts AS timestamp FROM events
"""

_INPUTS = {
    "raw_claims": ["lineitem", "orders"],
    "raw_bene": ["customer"],
    "raw_survey": ["customer"],
    "raw_overrides": ["events"],
}
_TEXTS = {
    "raw_claims": RAW_CLAIMS_SQL,
    "raw_bene": RAW_BENE_SQL,
    "raw_survey": RAW_SURVEY_SQL,
    "raw_overrides": RAW_OVERRIDES_SQL,
}


def adapter_sql(name: str) -> str:
    """Adapter text with plain table names (DuckDB oracle CTE body)."""
    return _TEXTS[name]


def _spark_text(name: str) -> str:
    # lines alike in number, part and supplier have the same claim columns, so their order by price needn't be told, nor the price shuffled
    text = _TEXTS[name].replace("l_suppkey,l_extendedprice)", "l_suppkey)")
    for t in _INPUTS[name]:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return text


def load_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one adapter text over the driver parquet tables.

    Tables are passed as DataFrame parameters, so no global view names are
    created and two scale factors can share one session.
    """
    frames = {t: spread_small(spark.read.parquet(table_path(sf_dir, t))) for t in _INPUTS[name]}
    return spark.sql(_spark_text(name), **frames)


def spread_small(df: DataFrame) -> DataFrame:
    """Input-partition guard: a table stored as one small file scans as one
    partition, which would run every later narrow step in a single task.
    Spread it only when it has fewer partitions than the cluster has cores;
    large multi-file inputs (the 100 TB case) pass through untouched."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_raw(spark, sf_dir, "raw_claims")


def raw_bene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_raw(spark, sf_dir, "raw_bene")


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_raw(spark, sf_dir, "raw_survey")


def raw_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_raw(spark, sf_dir, "raw_overrides")
