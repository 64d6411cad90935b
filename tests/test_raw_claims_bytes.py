"""What the stage tables move: lines are ranked without their price, tables are written with zstd."""
import glob

import duckdb
import pyarrow.parquet as pq
import pytest

from claimspark.plans import pipeline as P
from claimspark.sources import fixtures as FX


@pytest.fixture
def odd_lines(tmp_path):
    """Lines alike in number, part and supplier, with other prices; an order without lines."""
    lines = [(1, 7, 3, 1, 9.0), (1, 7, 3, 1, 5.0), (1, 2, 4, 2, 1.0), (1, 9, 4, 2, 0.5), (1, 5, 8, 2, 7.0), (2, 6, 1, 3, 2.0), (2, 6, 1, 3, 2.0), (2, 4, 1, 1, 2.0)]
    c = duckdb.connect()
    values = ", ".join(f"({a}::BIGINT, {b}::BIGINT, {s}::BIGINT, {n}::INT, {x}::DOUBLE)" for a, b, s, n, x in lines)
    c.execute(f"COPY (SELECT * FROM (VALUES {values}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.execute("COPY (SELECT * FROM (VALUES (1::BIGINT, 5::BIGINT, 40000.0::DOUBLE, TIMESTAMP '1995-03-01', '1-URGENT'), (2, 5, 30000.0, TIMESTAMP '1996-04-02', '5-LOW'), "
              f"(3, 6, 100.0, TIMESTAMP '1997-05-03', '2-HIGH')) t(o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_lines_are_ranked_without_their_price(spark, odd_lines):
    got = FX.raw_claims(spark, odd_lines)
    text = FX.adapter_sql("raw_claims")
    assert "l_extendedprice" in text  # the DuckDB oracle's text stays
    for t in ("lineitem", "orders"):
        text = text.replace(f"FROM {t}", f"FROM parquet.`{odd_lines}/{t}.parquet`")
    want = spark.sql(text)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    assert "l_extendedprice" not in got._jdf.queryExecution().executedPlan().toString()


def test_stage_tables_are_zstd(spark, sf_small):
    P.claims_raw(spark, sf_small)
    path = next(v for k, v in P._TABLES.items() if k[1:] == (sf_small, "claims_raw")).removeprefix("file:")
    files = glob.glob(f"{path}/sample_num=*/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
