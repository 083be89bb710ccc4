"""The queries that SQL can say against their statements."""

import duckdb
import pytest

from tickloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert mine == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
