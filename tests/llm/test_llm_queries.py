"""The queries of the subpackage that have SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from lumenquote.llm import queries

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    theirs = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in theirs.description)
    ours = queries.queries()[name](spark, str(DATA))
    assert sorted(ours.columns) == columns

    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    at = [[c[0] for c in theirs.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
