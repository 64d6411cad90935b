"""DuckDB oracle texts: the same tables derived independently in plain SQL.

Each oracle query is ``WITH <shared CTEs> <final SELECT>``. The CTEs below
re-state the cleaning, feature and label rules in SQL so that the Spark
DataFrame code is checked against a second, independent formulation.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.mathx import hash_uniform_sql
from ..sources.fixtures import adapter_sql


def nt(c: str) -> str:
    return f"(CASE WHEN {c} IN ('', ' ', 'NA') THEN NULL ELSE {c} END)"


def d8(c: str) -> str:
    return f"CAST(try_strptime(regexp_replace(trim({nt(c)}), '^0+$', ''), '%Y%m%d') AS DATE)"


def npi(c: str) -> str:
    x = f"regexp_replace(trim({nt(c)}), '\\.0$', '')"
    return f"(CASE WHEN {x} IN ('', '0') THEN NULL ELSE {x} END)"


def icd(c: str, normalise: bool = False) -> str:
    if normalise:
        c = f"NULLIF(upper(trim({c})), '')"
    h = f"substr({c}, 1, 3)"
    return (f"(CASE WHEN {c} IS NULL THEN NULL WHEN starts_with({c}, 'V') THEN 900 "
            f"WHEN starts_with({c}, 'E') THEN 950 "
            f"WHEN regexp_matches({h}, '^[+-]?[0-9]+$') THEN CAST({h} AS INTEGER) ELSE NULL END)")


def flag(cond: str) -> str:
    return f"CAST(({cond}) AS INTEGER)"


def pres(c: str) -> str:
    return f"CAST(({c}) IS NOT NULL AS INTEGER)"


RAW = {
    "raw_claims": f"raw_claims AS ({adapter_sql('raw_claims')})",
    "raw_bene": f"raw_bene AS ({adapter_sql('raw_bene')})",
    "raw_survey": f"raw_survey AS ({adapter_sql('raw_survey')})",
    "raw_overrides": f"raw_overrides AS ({adapter_sql('raw_overrides')})",
}

_cc_cols = ",\n ".join([
    f"{nt('DESYNPUF_ID')} AS bene_id", f"{nt('CLM_ID')} AS claim_id",
    f"{d8('CLM_FROM_DT')} AS CLM_FROM_DT", f"{d8('CLM_THRU_DT')} AS CLM_THRU_DT",
    "CAST(NULL AS DATE) AS CLM_ADMSN_DT", "CAST(NULL AS DATE) AS NCH_BENE_DSCHRG_DT",
    "CAST(NULL AS VARCHAR) AS PRVDR_NUM",
    f"{npi('AT_PHYSN_NPI')} AS AT_PHYSN_NPI", f"{npi('OP_PHYSN_NPI')} AS OP_PHYSN_NPI",
    "TRY_CAST(CLM_PMT_AMT AS DOUBLE) AS CLM_PMT_AMT",
    "TRY_CAST(NCH_PRMRY_PYR_CLM_PD_AMT AS DOUBLE) AS NCH_PRMRY_PYR_CLM_PD_AMT",
    f"{nt('CLM_UTLZTN_DAY_CNT')} AS CLM_UTLZTN_DAY_CNT", f"{nt('CLM_DRG_CD')} AS CLM_DRG_CD",
    f"{nt('ADMTNG_ICD9_DGNS_CD')} AS ADMTNG_ICD9_DGNS_CD",
    f"{nt('ICD9_DGNS_CD_1')} AS ICD9_DGNS_CD_1", f"{nt('ICD9_DGNS_CD_2')} AS ICD9_DGNS_CD_2",
    f"{nt('ICD9_DGNS_CD_3')} AS ICD9_DGNS_CD_3",
    f"{nt('ICD9_PRCDR_CD_1')} AS ICD9_PRCDR_CD_1", f"{nt('ICD9_PRCDR_CD_2')} AS ICD9_PRCDR_CD_2",
    "CAST(NULL AS DOUBLE) AS NCH_BENE_IP_DDCTBL_AMT", "CAST(NULL AS DOUBLE) AS NCH_BENE_BLOOD_DDCTBL_LBLTY_AM",
    f"{nt('HCPCS_CD_1')} AS HCPCS_CD_1", "CAST(NULL AS VARCHAR) AS HCPCS_CD_2",
    "CAST(NULL AS DOUBLE) AS NCH_BENE_PTB_DDCTBL_AMT",
    "claim_type",
])
CC = (f"cc AS (SELECT {_cc_cols}\n FROM raw_claims "
      f"WHERE claim_type = 'OP' OR trim({nt('SEGMENT')}) = '1')")

_sp = [s for s, _ in K.CHRONIC_SOURCE_COLS]
_cb_cols = ",\n ".join(
    [f"{nt('DESYNPUF_ID')} AS bene_id", f"{d8('BENE_BIRTH_DT')} AS BENE_BIRTH_DT",
     f"{d8('BENE_DEATH_DT')} AS BENE_DEATH_DT",
     "CAST(BENE_SEX_IDENT_CD AS INTEGER) AS BENE_SEX_IDENT_CD", "CAST(BENE_RACE_CD AS INTEGER) AS BENE_RACE_CD",
     f"upper({nt('BENE_ESRD_IND')}) = 'Y' AS BENE_ESRD_IND"]
    + [f"TRY_CAST({c} AS INTEGER) AS {c}" for c in _sp]
    + ["TRY_CAST(BENE_HI_CVRAGE_TOT_MONS AS INTEGER) AS BENE_HI_CVRAGE_TOT_MONS",
       "CAST(NULL AS INTEGER) AS BENE_SMI_CVRAGE_TOT_MONS",
       "TRY_CAST(BENE_HMO_CVRAGE_TOT_MONS AS INTEGER) AS BENE_HMO_CVRAGE_TOT_MONS"])
CB = f"cb AS (SELECT {_cb_cols}\n FROM raw_bene)"
CR = ("cr AS (SELECT cc.*, cb.* EXCLUDE (bene_id), CAST(1 AS INTEGER) AS sample_num "
      "FROM cc LEFT JOIN cb ON cc.bene_id = cb.bene_id)")

_age = "CAST(TRUNC(datediff('day', BENE_BIRTH_DT, CLM_FROM_DT) / 365.25) AS INTEGER)"
_f_cols = ",\n ".join(
    ["claim_id", "bene_id", "claim_type", "sample_num",
     flag("claim_type = 'IP'") + " AS is_inpatient",
     "CAST(datediff('day', CLM_FROM_DT, CLM_THRU_DT) AS INTEGER) AS los_days",
     "CAST(year(CLM_FROM_DT) AS INTEGER) AS claim_year", "CAST(month(CLM_FROM_DT) AS INTEGER) AS claim_month",
     "COALESCE(CLM_PMT_AMT, 0.0) AS clm_pmt_amt", "COALESCE(NCH_PRMRY_PYR_CLM_PD_AMT, 0.0) AS primary_payer_amt",
     flag("COALESCE(NCH_PRMRY_PYR_CLM_PD_AMT, 0.0) > 0") + " AS has_primary_payer",
     flag("COALESCE(CLM_PMT_AMT, 0.0) < 0") + " AS is_adjustment",
     pres("AT_PHYSN_NPI") + " AS prior_auth_present", pres("OP_PHYSN_NPI") + " AS has_op_surgeon",
     f"CASE WHEN ADMTNG_ICD9_DGNS_CD IS NOT NULL THEN {icd('ADMTNG_ICD9_DGNS_CD')} "
     f"ELSE {icd('ICD9_DGNS_CD_1')} END AS primary_icd9_num",
     f"({pres('ICD9_DGNS_CD_1')} + {pres('ICD9_DGNS_CD_2')} + {pres('ICD9_DGNS_CD_3')}) AS num_diagnoses",
     f"({pres('ICD9_PRCDR_CD_1')} + {pres('ICD9_PRCDR_CD_2')}) AS num_procedures",
     pres("ICD9_PRCDR_CD_1") + " AS has_procedure", pres("HCPCS_CD_1") + " AS has_hcpcs",
     "TRY_CAST(CLM_DRG_CD AS INTEGER) AS drg_num", "TRY_CAST(CLM_UTLZTN_DAY_CNT AS INTEGER) AS utlztn_days",
     f"{_age} AS bene_age", "BENE_SEX_IDENT_CD AS bene_sex", "BENE_RACE_CD AS bene_race",
     "CAST(BENE_ESRD_IND AS INTEGER) AS bene_esrd", "BENE_HI_CVRAGE_TOT_MONS AS bene_hi_mons",
     "BENE_HMO_CVRAGE_TOT_MONS AS bene_hmo_mons", pres("BENE_DEATH_DT") + " AS bene_is_deceased"]
    + [flag(f"{s} = 1") + f" AS {d}" for s, d in K.CHRONIC_SOURCE_COLS]
    + ["(" + " + ".join(f"COALESCE({flag(s + ' = 1')}, 0)" for s in _sp) + ") AS chronic_count"])
F0 = f"f0 AS (SELECT {_f_cols}\n FROM cr)"

SV = ("sv AS (SELECT TRY_CAST(AGELAST AS DOUBLE) AS age, TRY_CAST(INSCOVX AS DOUBLE) AS ins, GREATEST("
      + ", ".join(f"COALESCE(CAST(TRY_CAST({c} AS DOUBLE) = 1 AS INTEGER), 0)"
                  for c in ("UNABL42", "DELAY42", "NOPROB42"))
      + ") AS denied FROM raw_survey WHERE AGELAST IS NOT NULL AND INSCOVX IS NOT NULL)")
SR = ("sr AS (SELECT CASE WHEN age > -1 AND age <= 17 THEN '0-17' WHEN age > 17 AND age <= 44 THEN '18-44' "
      "WHEN age > 44 AND age <= 64 THEN '45-64' WHEN age > 64 AND age <= 999 THEN '65+' ELSE 'unknown' END "
      "AS age_group, CASE WHEN ins = 1 THEN 'private' WHEN ins = 2 THEN 'public' WHEN ins = 3 THEN 'uninsured' "
      "ELSE 'unknown' END AS insurance_type, AVG(CAST(denied AS DOUBLE)) AS denial_rate, "
      "CAST(COUNT(*) AS INTEGER) AS n, 'meps_file' AS source FROM sv WHERE age IS NOT NULL GROUP BY 1, 2)")
IC = ("ic AS (SELECT AVG(denial_rate) AS base_rate, "
      "LN(AVG(denial_rate) / (1 - AVG(denial_rate))) AS intercept FROM sr)")


def _lo_sql() -> str:
    z = lambda c: f"COALESCE(CAST({c} AS DOUBLE), 0.0)"
    b = lambda cond: f"CAST(({cond}) AS DOUBLE)"
    terms = [
        (K.W_NO_PRIOR_AUTH, f"(1.0 - {z('prior_auth_present')})"),
        (K.W_ZERO_OR_NEG_PAYMENT, b(f"{z('clm_pmt_amt')} <= 0")),
        (K.W_VCODE_PRIMARY, b(f"{z('primary_icd9_num')} >= 900")),
        (K.W_ZERO_LOS_INPATIENT, b(f"{z('is_inpatient')} = 1 AND COALESCE(CAST(los_days AS DOUBLE), 1.0) <= 0")),
        (K.W_HIGH_COST, b(f"{z('clm_pmt_amt')} > {K.HIGH_COST_AMOUNT}")),
        (K.W_CHRONIC_BURDEN, f"({z('chronic_count')} / 10.0)"),
        (K.W_COVERAGE_STABILITY, f"({z('bene_hi_mons')} / 12.0)"),
        (K.W_HAS_HMO, b(f"{z('bene_hmo_mons')} > 0")),
    ]
    return "(ic.intercept + " + " + ".join(f"CAST({w!r} AS DOUBLE) * {t}" for w, t in terms) + ")"


LO_SQL = _lo_sql()
FL = (f"fl AS (SELECT f0.*, {LO_SQL} AS log_odds FROM f0, ic)")
FT = ("f AS (SELECT fl.* EXCLUDE (log_odds), 1.0 / (1.0 + EXP(-GREATEST(-20.0, LEAST(20.0, log_odds)))) "
      "AS denial_prob, "
      f"CAST({hash_uniform_sql('claim_id', K.LABEL_SEED)} < 1.0 / (1.0 + EXP(-GREATEST(-20.0, LEAST(20.0, "
      "log_odds)))) AS INTEGER) AS denial_label FROM fl)")

# name -> (sql, dependencies)
CTES = {
    "raw_claims": (RAW["raw_claims"], []),
    "raw_bene": (RAW["raw_bene"], []),
    "raw_survey": (RAW["raw_survey"], []),
    "raw_overrides": (RAW["raw_overrides"], []),
    "cc": (CC, ["raw_claims"]),
    "cb": (CB, ["raw_bene"]),
    "cr": (CR, ["cc", "cb"]),
    "f0": (F0, ["cr"]),
    "sv": (SV, ["raw_survey"]),
    "sr": (SR, ["sv"]),
    "ic": (IC, ["sr"]),
    "fl": (FL, ["f0", "ic"]),
    "f": (FT, ["fl"]),
}


def register(name: str, sql: str, deps: list[str]) -> None:
    CTES[name] = (sql, deps)


def with_ctes(needs: list[str], body: str) -> str:
    """Assemble ``WITH`` + the CTEs ``needs`` depends on, in order, + body."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(CTES[n][0] for n in order) + "\n" + body


# --- scorecard attributions ------------------------------------------------
def _term_sqls() -> dict[str, str]:
    z = lambda c: f"COALESCE(CAST({c} AS DOUBLE), 0.0)"
    b = lambda cond: f"CAST(({cond}) AS DOUBLE)"
    return {
        "no_prior_auth": f"(1.0 - {z('prior_auth_present')})",
        "zero_or_neg_payment": b(f"{z('clm_pmt_amt')} <= 0"),
        "vcode_primary": b(f"{z('primary_icd9_num')} >= 900"),
        "high_cost": b(f"{z('clm_pmt_amt')} > {K.HIGH_COST_AMOUNT}"),
        "chronic_burden": f"({z('chronic_count')} / 10.0)",
        "coverage_stability": f"({z('bene_hi_mons')} / 12.0)",
        "has_hmo": b(f"{z('bene_hmo_mons')} > 0"),
        "a": b(f"{z('is_inpatient')} = 1"),
        "b": b("COALESCE(CAST(los_days AS DOUBLE), 1.0) <= 0"),
    }


_W = {"no_prior_auth": K.W_NO_PRIOR_AUTH, "zero_or_neg_payment": K.W_ZERO_OR_NEG_PAYMENT,
      "vcode_primary": K.W_VCODE_PRIMARY, "high_cost": K.W_HIGH_COST, "chronic_burden": K.W_CHRONIC_BURDEN,
      "coverage_stability": K.W_COVERAGE_STABILITY, "has_hmo": K.W_HAS_HMO}
_TF = {"no_prior_auth": "prior_auth_present", "zero_or_neg_payment": "clm_pmt_amt",
       "vcode_primary": "primary_icd9_num", "high_cost": "clm_pmt_amt", "chronic_burden": "chronic_count",
       "coverage_stability": "bene_hi_mons", "has_hmo": "bene_hmo_mons"}
_ts = _term_sqls()
TM = "tm AS (SELECT f.*, " + ", ".join(f"{v} AS t_{k}" for k, v in _ts.items()) + " FROM f)"
MU = ("mu AS (SELECT " + ", ".join(f"AVG(t_{k}) AS m_{k}" for k in _ts)
      + ", AVG(t_a * t_b) AS m_ab FROM tm)")


def _phi_sql() -> dict[str, str]:
    phi = {f: "CAST(0.0 AS DOUBLE)" for f in K.FEATURE_COLS}
    parts: dict[str, list[str]] = {}
    for n, feat in _TF.items():
        parts.setdefault(feat, []).append(f"CAST({_W[n]!r} AS DOUBLE) * (t_{n} - m_{n})")
    for feat, ps in parts.items():
        phi[feat] = " + ".join(ps)
    h = K.W_ZERO_LOS_INPATIENT * 0.5
    phi["is_inpatient"] = f"CAST({h!r} AS DOUBLE) * ((t_a * m_b - m_ab) + (t_a * t_b - m_a * t_b))"
    phi["los_days"] = f"CAST({h!r} AS DOUBLE) * ((m_a * t_b - m_ab) + (t_a * t_b - t_a * m_b))"
    return phi


PHI = _phi_sql()
BASE_SQL = ("(ic.intercept + " + " + ".join(f"CAST({_W[n]!r} AS DOUBLE) * m_{n}" for n in _TF)
            + f" + CAST({K.W_ZERO_LOS_INPATIENT!r} AS DOUBLE) * m_ab)")
SH = ("sh AS (SELECT tm.*, " + BASE_SQL + " AS base_value, "
      + ", ".join(f"({PHI[f]}) AS phi_{f}" for f in K.FEATURE_COLS) + " FROM tm, mu, ic)")
FI = ("fi AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(K.FEATURE_COLS))
      + ") t(feature, idx))")
LG = ("lg AS (" + " UNION ALL ".join(
    f"SELECT claim_id, '{f}' AS feature, {i} AS idx, CAST(phi_{f} AS DOUBLE) AS value, CAST({f} AS DOUBLE) AS x "
    f"FROM sh" for i, f in enumerate(K.FEATURE_COLS)) + ")")
RK = ("rk AS (SELECT lg.*, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY ROUND(-ABS(value), 9), idx) "
      "AS rnk FROM lg)")


def _q(s: str) -> str:
    return s.replace("'", "''")


HT = ("ht AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{_q(K.HINTS.get(f, K.DEFAULT_HINT))}')"
                                                   for f in K.FEATURE_COLS) + ") t(feature, hint))")
GI = ("gi AS (SELECT feature, idx, ROUND(AVG(ABS(value)), 6) AS mean_abs_shap, "
      "ROW_NUMBER() OVER (ORDER BY ROUND(AVG(ABS(value)), 9) DESC, idx) AS rank FROM lg GROUP BY feature, idx)")

CTES.update({
    "tm": (TM, ["f"]), "mu": (MU, ["tm"]), "sh": (SH, ["tm", "mu", "ic"]), "fi": (FI, []),
    "lg": (LG, ["sh"]), "rk": (RK, ["lg"]), "ht": (HT, []), "gi": (GI, ["lg"]),
})
