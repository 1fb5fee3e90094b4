"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from lumenquote.plans import registry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def comparable(frame):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


def test_streaming_gives_the_batch_result(spark, tmp_path):
    from lumenquote.streaming.parse import answer_stream, evidence_stream, write_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.parquet").symlink_to(DATA / "answers.parquet")
    schema = spark.read.parquet(str(DATA / "answers.parquet")).schema
    write_stream(evidence_stream(answer_stream(spark, str(folder), schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert comparable(spark.read.parquet(str(tmp_path / "out")).toPandas()) == comparable(registry.queries()["parse_evidence"](spark, str(DATA)).toPandas())
