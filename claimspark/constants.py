"""Fixed values that must equal the reference's for right results.

Everything in this module is data, not logic: feature order, code maps, the
label scorecard, the literature rate table, hint and label texts, and the
letter templates. They are listed plainly and in their natural order.
"""

from __future__ import annotations

# --- fixed values: 36 model features, in contract order -------------------
CHRONIC_SOURCE_COLS = [
    ("SP_ALZHDMTA", "has_alzheimer"),
    ("SP_CHF", "has_chf"),
    ("SP_CHRNKIDN", "has_ckd"),
    ("SP_CNCR", "has_cancer"),
    ("SP_COPD", "has_copd"),
    ("SP_DEPRESSN", "has_depression"),
    ("SP_DIABETES", "has_diabetes"),
    ("SP_ISCHMCHT", "has_ihd"),
    ("SP_OSTEOPRS", "has_osteoporosis"),
    ("SP_RA_OA", "has_ra_oa"),
    ("SP_STRKETIA", "has_stroke"),
]
CHRONIC_FEATURES = [dst for _, dst in CHRONIC_SOURCE_COLS]

FEATURE_COLS = [
    "is_inpatient", "los_days", "claim_year", "claim_month",
    "clm_pmt_amt", "primary_payer_amt", "has_primary_payer", "is_adjustment",
    "prior_auth_present", "has_op_surgeon",
    "primary_icd9_num", "num_diagnoses", "num_procedures",
    "has_procedure", "has_hcpcs", "drg_num", "utlztn_days",
    "bene_age", "bene_sex", "bene_race", "bene_esrd",
    "bene_hi_mons", "bene_hmo_mons", "bene_is_deceased",
    *CHRONIC_FEATURES,
    "chronic_count",
]
ID_COLS = ["claim_id", "bene_id", "claim_type", "sample_num"]
PROTECTED_FEATURES = ["bene_age", "bene_sex", "bene_race"]

# --- fixed values: raw column lists per file kind --------------------------
BENE_COLS = [
    "DESYNPUF_ID", "BENE_BIRTH_DT", "BENE_DEATH_DT",
    "BENE_SEX_IDENT_CD", "BENE_RACE_CD", "BENE_ESRD_IND",
    "SP_ALZHDMTA", "SP_CHF", "SP_CHRNKIDN", "SP_CNCR", "SP_COPD",
    "SP_DEPRESSN", "SP_DIABETES", "SP_ISCHMCHT", "SP_OSTEOPRS", "SP_RA_OA", "SP_STRKETIA",
    "BENE_HI_CVRAGE_TOT_MONS", "BENE_SMI_CVRAGE_TOT_MONS", "BENE_HMO_CVRAGE_TOT_MONS",
]
IP_COLS = [
    "DESYNPUF_ID", "CLM_ID", "SEGMENT",
    "CLM_FROM_DT", "CLM_THRU_DT", "CLM_ADMSN_DT", "NCH_BENE_DSCHRG_DT",
    "PRVDR_NUM", "AT_PHYSN_NPI", "OP_PHYSN_NPI",
    "CLM_PMT_AMT", "NCH_PRMRY_PYR_CLM_PD_AMT",
    "CLM_UTLZTN_DAY_CNT", "CLM_DRG_CD",
    "ADMTNG_ICD9_DGNS_CD",
    "ICD9_DGNS_CD_1", "ICD9_DGNS_CD_2", "ICD9_DGNS_CD_3",
    "ICD9_PRCDR_CD_1", "ICD9_PRCDR_CD_2",
    "NCH_BENE_IP_DDCTBL_AMT", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM",
]
OP_COLS = [
    "DESYNPUF_ID", "CLM_ID",
    "CLM_FROM_DT", "CLM_THRU_DT",
    "PRVDR_NUM", "AT_PHYSN_NPI", "OP_PHYSN_NPI",
    "CLM_PMT_AMT", "NCH_PRMRY_PYR_CLM_PD_AMT",
    "ICD9_DGNS_CD_1", "ICD9_DGNS_CD_2", "ICD9_DGNS_CD_3",
    "ICD9_PRCDR_CD_1", "ICD9_PRCDR_CD_2",
    "HCPCS_CD_1", "HCPCS_CD_2",
    "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM", "NCH_BENE_PTB_DDCTBL_AMT",
]
AMOUNT_COLS = [
    "CLM_PMT_AMT", "NCH_PRMRY_PYR_CLM_PD_AMT",
    "NCH_BENE_IP_DDCTBL_AMT", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM",
    "NCH_BENE_PTB_DDCTBL_AMT",
]
CLAIM_DATE_COLS = ["CLM_FROM_DT", "CLM_THRU_DT", "CLM_ADMSN_DT", "NCH_BENE_DSCHRG_DT"]
NPI_COLS = ["AT_PHYSN_NPI", "OP_PHYSN_NPI"]
CSV_NULL_TOKENS = ["", "NA"]  # plus a single blank, see functions.codes.csv_null

# --- fixed values: survey (MEPS-style) column candidates --------------------
SURVEY_AGE_CANDIDATES = ["AGELAST", "AGE12X", "AGE42X", "AGE31X", "AGE53X"]
SURVEY_INSCOV_CANDIDATES = ["INSCOVX", "INSCOV", "INSOV42X", "INSCOV31X"]
SURVEY_DENIAL_CANDIDATES = [
    "DNTLV31", "DNTLV42", "DNTLV53",
    "WLKDFT31", "WLKDFT42", "WLKDFT53",
    "UNABL31", "UNABL42", "UNABL53",
    "DELAY31", "DELAY42", "DELAY53",
    "NOPROB31", "NOPROB42",
]
INSURANCE_CODES = {1: "private", 2: "public", 3: "uninsured"}

# --- fixed values: published survey denial rates (literature fallback) -----
LITERATURE_RATES = [
    ("0-17", "private", 0.07),
    ("0-17", "public", 0.10),
    ("0-17", "uninsured", 0.18),
    ("18-44", "private", 0.13),
    ("18-44", "public", 0.17),
    ("18-44", "uninsured", 0.22),
    ("45-64", "private", 0.15),
    ("45-64", "public", 0.19),
    ("45-64", "uninsured", 0.25),
    ("65+", "private", 0.09),
    ("65+", "public", 0.10),
    ("65+", "uninsured", 0.14),
]

# --- fixed values: label scorecard weights (log-odds) ----------------------
W_NO_PRIOR_AUTH = 0.80
W_ZERO_OR_NEG_PAYMENT = 1.20
W_VCODE_PRIMARY = 0.30
W_ZERO_LOS_INPATIENT = 0.50
W_HIGH_COST = 0.20
W_CHRONIC_BURDEN = 0.15
W_COVERAGE_STABILITY = -0.10
W_HAS_HMO = -0.20
HIGH_COST_AMOUNT = 10000.0
SIGMOID_CLIP = 20.0
LABEL_SEED = 42

# --- fixed values: decision thresholds --------------------------------------
DENY_THRESHOLD = 0.5        # decision: DENY if p > 0.5
METRIC_THRESHOLD = 0.5      # metrics: predicted positive if p >= 0.5
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4

# --- fixed values: counterfactual hints per feature -------------------------
HINTS = {
    "prior_auth_present": "Obtain prior authorization -- missing NPI indicates auth was not on file at time of claim submission.",
    "clm_pmt_amt": "Review the billed amount against the Medicare fee schedule; an unusually high or negative amount triggers elevated denial risk.",
    "primary_payer_amt": "Verify primary payer coordination -- discrepancies in primary payer amount increase denial probability.",
    "has_primary_payer": "Confirm primary payer information is complete; missing primary payer data raises denial risk.",
    "is_adjustment": "Adjustment claims carry higher denial risk; include the original claim reference and detailed reason.",
    "num_diagnoses": "Ensure all supporting diagnosis codes are documented; low diagnosis count may signal incomplete documentation.",
    "num_procedures": "Verify all performed procedures are coded; undercoding procedures can reduce medical necessity support.",
    "has_procedure": "Attach procedure documentation -- claims without procedure codes have elevated denial rates.",
    "has_hcpcs": "Supply HCPCS codes for all supplies and services rendered.",
    "primary_icd9_num": "Confirm the primary diagnosis code is the most specific ICD code available for the condition.",
    "drg_num": "Verify DRG assignment is accurate for the documented diagnoses and procedures.",
    "utlztn_days": "Document medical necessity for each utilization day; long stays without clear progression trigger review.",
    "los_days": "Provide clinical justification for length of stay; unusually long stays relative to DRG may be denied.",
    "chronic_count": "Ensure all active chronic conditions are captured in the claim; under-reporting comorbidities reduces risk-adjustment.",
    "bene_age": "No corrective action -- patient age is a read-only demographic factor.",
    "is_inpatient": "If this is an inpatient claim, confirm the inpatient admission criteria are met and documented.",
    "has_op_surgeon": "Ensure the operating surgeon NPI is included for all surgical procedures.",
}
DEFAULT_HINT = "Review supporting documentation for this feature and ensure the claim record is complete and accurate."
APPROVED_HINT = "This claim is predicted as APPROVED -- no corrective actions required."

# --- fixed values: plain-English feature labels -----------------------------
FEATURE_LABELS = {
    "prior_auth_present": "Prior authorization on file",
    "clm_pmt_amt": "Claim payment amount",
    "primary_payer_amt": "Primary payer amount",
    "has_primary_payer": "Primary payer present",
    "is_adjustment": "Adjustment claim indicator",
    "is_inpatient": "Inpatient admission",
    "los_days": "Length of stay (days)",
    "claim_year": "Claim year",
    "claim_month": "Claim month",
    "primary_icd9_num": "Primary diagnosis code (numeric)",
    "num_diagnoses": "Number of diagnosis codes",
    "num_procedures": "Number of procedure codes",
    "has_procedure": "Procedure code present",
    "has_hcpcs": "HCPCS supply/service code present",
    "has_op_surgeon": "Operating surgeon NPI present",
    "drg_num": "DRG (Diagnosis Related Group)",
    "utlztn_days": "Utilization days",
    "bene_age": "Beneficiary age",
    "bene_sex": "Beneficiary sex",
    "bene_race": "Beneficiary race",
    "bene_esrd": "End-Stage Renal Disease indicator",
    "bene_hi_mons": "Hospital Insurance enrollment months",
    "bene_hmo_mons": "HMO enrollment months",
    "bene_is_deceased": "Deceased beneficiary flag",
    "has_alzheimer": "Alzheimer's disease / dementia",
    "has_chf": "Congestive heart failure",
    "has_ckd": "Chronic kidney disease",
    "has_cancer": "Cancer",
    "has_copd": "Chronic obstructive pulmonary disease",
    "has_depression": "Depression",
    "has_diabetes": "Diabetes",
    "has_ihd": "Ischemic heart disease",
    "has_osteoporosis": "Osteoporosis",
    "has_ra_oa": "Rheumatoid / osteo arthritis",
    "has_stroke": "Stroke / TIA",
    "chronic_count": "Total chronic condition count",
}

# --- fixed values: member-letter plain-text reasons -------------------------
DENIAL_PLAIN_TEXT = {
    "prior_auth_present":
        "     Our records do not show a prior authorization reference for this service.\n"
        "     Please contact your provider to submit a corrected claim with the\n"
        "     authorization number if one was obtained.\n",
    "clm_pmt_amt":
        "     The billed amount falls outside the expected range for this service\n"
        "     under the applicable fee schedule.\n",
    "is_adjustment":
        "     This is an adjustment claim.  Please include the original claim number\n"
        "     and a detailed reason for adjustment.\n",
    "num_diagnoses":
        "     The claim contains fewer diagnosis codes than expected for this service.\n"
        "     Ensure all active conditions are documented.\n",
    "has_procedure":
        "     No procedure codes were found on this claim.  Please verify coding\n"
        "     and resubmit if procedures were performed.\n",
    "drg_num":
        "     The DRG assignment could not be validated against the documented\n"
        "     diagnoses and procedures.  Please review and resubmit.\n",
}
DEFAULT_PLAIN_TEXT = "     Please review this item with your provider's billing office.\n"

# --- fixed values: letter and summary templates -----------------------------
MEMBER_HEADER = (
    "NOTICE OF CLAIM DETERMINATION\n"
    "--------------------------------------------------------------\n"
    "Date:          {today}\n"
    "Member ID:     {member_id}\n"
    "Claim ID:      {claim_id}\n"
    "Service Date:  {service_date}\n"
    "Provider:      {provider}\n"
    "--------------------------------------------------------------\n"
    "\n"
    "Dear Member,\n"
    "\n"
    "We have reviewed your claim and have made the following determination:\n"
    "\n"
    "  CLAIM STATUS: {status}\n"
    "  Denial Probability Score: {prob_pct}\n"
    "\n"
)
MEMBER_APPROVED = (
    "Your claim has been APPROVED for processing.  Payment will be issued\n"
    "in accordance with your plan benefits.\n"
)
MEMBER_DENIED_INTRO = (
    "Your claim has been DENIED.  The specific reasons for this determination\n"
    "are listed below.  You have the right to appeal this decision.\n"
    "\n"
    "REASONS FOR DENIAL:\n"
)
MEMBER_ACTIONS_HEADER = "\nACTIONS THAT MAY RESOLVE THIS DENIAL:\n"
MEMBER_APPEAL = (
    "\n"
    "YOUR RIGHT TO APPEAL\n"
    "--------------------------------------------------------------\n"
    "You have 180 days from the date of this notice to file an appeal.\n"
    "To initiate an appeal, please contact us at:\n"
    "\n"
    "  Phone : 1-800-555-0100\n"
    "  Mail  : Appeals & Grievances Department\n"
    "          PO Box 12345, Anytown, USA 00000\n"
    "  Online: member.healthplan.example/appeals\n"
    "\n"
    "Please include this notice and any supporting clinical documentation\n"
    "with your appeal submission.\n"
    "\n"
    "If you believe this denial is related to a data or administrative error\n"
    "(such as a missing prior authorization reference), please contact your\n"
    "provider's billing office to submit a corrected claim.\n"
    "\n"
    "This determination was assisted by an AI system.  All final decisions\n"
    "are subject to review by a licensed claims adjuster.\n"
    "--------------------------------------------------------------\n"
)
ADJUSTER_HEADER = (
    "ADJUSTER REVIEW SUMMARY (INTERNAL)\n"
    "======================================================\n"
    "Claim ID       : {claim_id}\n"
    "Member ID      : {member_id}\n"
    "Review Date    : {today}\n"
    "Model          : {model_name}\n"
    "------------------------------------------------------\n"
    "Denial Probability : {prob4}  ({prob_pct})\n"
    "Recommended Action : {action}\n"
    "\n"
    "======================================================\n"
    "\n"
)
ADJUSTER_SHAP = (
    "SHAP EXPLANATION (top drivers, log-odds scale)\n"
    "------------------------------------------------------\n"
    "Base value (log-odds baseline): {base_value}\n"
    "\n"
    "{shap_rows}\n"
    "\n"
    "Note: positive SHAP -> pushes toward denial; negative -> toward approval.\n"
    "\n"
)
ADJUSTER_LIME = (
    "LIME LOCAL EXPLANATION (top {n} features)\n"
    "------------------------------------------------------\n"
    "Local intercept : {intercept}\n"
    "Local prediction: {local_pred}\n"
    "\n"
    "{lime_rows}\n"
    "\n"
)
ADJUSTER_COUNTERFACTUAL = (
    "COUNTERFACTUAL GUIDANCE\n"
    "------------------------------------------------------\n"
    "{hints}\n"
    "\n"
)
ADJUSTER_FOOTER = (
    "======================================================\n"
    "OVERRIDE INSTRUCTIONS\n"
    "If you override this determination, document the clinical or\n"
    "administrative reason in the audit panel before submitting.\n"
    "======================================================\n"
)
DENY_ACTION_TEXT = "DENY - review counterfactual hints below"

# --- fixed values: letter compliance checks (name, needle, case-insensitive) -
LETTER_CHECKS = [
    ("has_denial_reasons", "REASONS FOR DENIAL", False),
    ("has_appeal_right", "right to appeal", True),
    ("has_appeal_window", "180 days", False),
    ("has_contact", "1-800-", False),
    ("has_ai_disclosure", "AI system", False),
    ("has_corrective_actions", "ACTIONS THAT MAY", False),
]

# --- fixed values: the fully documented claim that what-if scores are held against
DOCUMENTED_CLAIM = {
    "is_inpatient": 0, "los_days": 0, "claim_year": 2008, "claim_month": 6, "clm_pmt_amt": 80.0, "primary_payer_amt": 20.0,
    "has_primary_payer": 1, "is_adjustment": 0, "prior_auth_present": 1, "has_op_surgeon": 1, "primary_icd9_num": 401,
    "num_diagnoses": 5, "num_procedures": 2, "has_procedure": 1, "has_hcpcs": 1, "drg_num": None, "utlztn_days": None,
    "bene_age": 68, "bene_sex": 1, "bene_race": 1, "bene_esrd": 0, "bene_hi_mons": 12, "bene_hmo_mons": 0,
    "bene_is_deceased": 0, "has_alzheimer": 0, "has_chf": 0, "has_ckd": 0, "has_cancer": 0, "has_copd": 0,
    "has_depression": 0, "has_diabetes": 1, "has_ihd": 1, "has_osteoporosis": 0, "has_ra_oa": 0, "has_stroke": 0,
    "chronic_count": 2,
}

# What-if scenarios of the registered queries: name, fields to overwrite.
WHAT_IF_SCENARIOS = [
    ("as filed", {}),
    ("prior authorisation entered", {"prior_auth_present": 1.0, "has_op_surgeon": 1.0}),
    ("payment and stay recorded", {"clm_pmt_amt": 80.0, "los_days": 2.0}),
    ("full year of coverage", {"bene_hi_mons": 12.0}),
    ("diagnosis withdrawn", {"primary_icd9_num": None}),
    ("everything documented", {"prior_auth_present": 1.0, "has_op_surgeon": 1.0, "clm_pmt_amt": 80.0, "los_days": 2.0,
                               "bene_hi_mons": 12.0, "primary_icd9_num": 401.0}),
]

# --- fixed values: override request rules -----------------------------------
OVERRIDE_DECISIONS = ["APPROVE", "DENY"]
OVERRIDE_REASON_MIN_LEN = 5
AUDIT_REASON_DISPLAY_LEN = 35

# --- fixed values: model defaults (config) ----------------------------------
GBT_PARAMS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8}
RF_PARAMS = {"numTrees": 500, "maxDepth": 6, "subsamplingRate": 0.8}
EARLY_STOPPING_ROUNDS = 20
TEST_FRACTION = 0.2
SPLIT_SEED = 42
SHAP_SAMPLE_SIZE = 2000
LIME_BACKGROUND_SIZE = 500
LIME_NUM_FEATURES = 10
LIME_NUM_SAMPLES = 1000
MISSING_SENTINEL = -9999.0
