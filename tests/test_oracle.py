"""A subset of the registered queries against their DuckDB oracles at sf0.001."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of

NAMES = ["denial_rate_by_prior_auth", "claims_bene_left_join", "feature_table", "icd9_prefix_normalised",
         "survey_rates", "label_summary", "validate_claims", "column_medians", "roc_auc", "average_precision",
         "scorecard_shap", "top_drivers", "waterfall", "protected_rank", "counterfactual_hints",
         "what_if_prior_auth", "what_if_scenarios", "what_if_own_corrections", "audit_page", "audit_report", "letter_compliance"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert rows_of(sdf) == rows_of(odf)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "denial_rate" in df.columns
