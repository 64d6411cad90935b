"""Column functions for raw claim cleaning (DT-1, STR-1..4, CAST-1..3).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: exact strings the raw CSV files use for "missing"
NULL_TOKENS = ["", " ", "NA"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_token(col) -> Column:
    """Raw CSV null rule: the exact tokens '', ' ' and 'NA' are missing."""
    c = _c(col)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def yyyymmdd_date(col) -> Column:
    """'YYYYMMDD' text -> date. Trimmed; all zeros, blank or invalid -> null."""
    cleaned = F.regexp_replace(F.trim(_c(col).cast("string")), r"^0+$", "")
    return F.try_to_date(cleaned, "yyyyMMdd")


def clean_npi(col) -> Column:
    """Provider id: trim, drop one trailing '.0'; '' and '0' -> null."""
    cleaned = F.regexp_replace(F.trim(_c(col).cast("string")), r"\.0$", "")
    return F.when(cleaned.isin("", "0"), F.lit(None).cast("string")).otherwise(cleaned)


def icd9_prefix(col, normalise: bool = False) -> Column:
    """ICD-9 code -> 3-digit numeric prefix; V-codes 900, E-codes 950.

    Strict form (feature pipeline): case-sensitive, no trim; anything whose
    first three characters are not an integer gives null.
    ``normalise=True`` (single-claim input form) trims and upper-cases first
    and treats an empty code as missing.
    """
    c = _c(col).cast("string")
    if normalise:
        c = F.upper(F.trim(c))
        c = F.when(c == "", F.lit(None).cast("string")).otherwise(c)
    head = F.substring(c, 1, 3)
    return (F.when(c.isNull(), F.lit(None).cast("int"))
             .when(c.startswith("V"), F.lit(900))
             .when(c.startswith("E"), F.lit(950))
             .when(head.rlike(r"^[+-]?[0-9]+$"), head.cast("int"))
             .otherwise(F.lit(None).cast("int")))


def lenient_int(col) -> Column:
    """Non-numeric text -> null instead of an error (CAST-1)."""
    return F.expr(f"try_cast(`{col}` AS INT)") if isinstance(col, str) else col.try_cast("int")


def lenient_double(col) -> Column:
    return F.expr(f"try_cast(`{col}` AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")


def yes_flag(col) -> Column:
    """'Y' in any case -> true; other text -> false; null stays null."""
    return F.upper(_c(col).cast("string")) == F.lit("Y")


def coded_flag(col) -> Column:
    """Survey/claims 1=yes 2=no coding -> 1/0 int; null stays null."""
    return (_c(col) == 1).cast("int")


def present(col) -> Column:
    return _c(col).isNotNull().cast("int")
