"""MAP-1: the attribution map of every claim, against DuckDB and the columns it is made of."""
import os

import duckdb

import __spark_entry__ as E
from claimspark import constants as K
from scripts.check_oracle import TABLES, rows_of


def test_attribution_map(spark, sf_small):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = E.queries()["attribution_map"](spark, sf_small).toPandas()
    want = con.execute(E.oracle_sql()["attribution_map"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    columns = {r.claim_id: r for r in E.queries()["scorecard_shap"](spark, sf_small).collect()}
    assert len(got) == len(columns)
    for claim_id, attributions in zip(got.claim_id, got.attributions):
        assert attributions == {f: columns[claim_id][f"phi_{f}"] for f in K.FEATURE_COLS}
