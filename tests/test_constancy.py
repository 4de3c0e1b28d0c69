"""The season-constancy audit: a feature at a time, equal to SQL where values are missing, zero or negative."""

import contextlib
import io

import pytest

from tallyfield.registry import ORACLES, QUERIES


@pytest.fixture
def odd(spark, tmp_path):
    """Three suppliers with twelve rows a season: null, zero, negative, constant and growing values, and one group of nine rows."""
    rows = []
    for s in (1, 2, 3):
        for i in range(12 if s < 3 else 9):
            tax = (None if i % 2 else -0.5, 0.0, float(i))[s - 1]
            rows.append((s, f"1996-0{1 + i % 9}-01", float(i % 4) if s == 1 else 7.0, tax, None if s == 2 else i % 3))
    schema = "l_suppkey long, day string, l_quantity double, l_tax double, l_linenumber int"
    spark.createDataFrame(rows, schema).selectExpr("*", "cast(day as timestamp_ntz) as l_shipdate").drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_odd_values_match_sql(spark, odd):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{odd}/lineitem.parquet/*.parquet'")
    got = QUERIES["a25_constancy"](spark, odd)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(con.execute(f'select {", ".join(cols)} from ({ORACLES["a25_constancy"]}) t').fetchall())


def test_a_table_of_counts_has_one_feature(spark, odd):
    """No step repeats each row once a feature before the rows are counted."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        QUERIES["a25_constancy"](spark, odd).explain()
    assert "HashAggregate" in said.getvalue()
    assert "Expand" not in said.getvalue() and "Generate" not in said.getvalue()
