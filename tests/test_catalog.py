"""The registered queries against their reference statements on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# a spread of shapes; tools/check.py compares every query
SAMPLE = ["log_returns", "period_returns", "rebase100", "flow_redate", "rename_ids", "corr_by_regime", "action_parse", "tri_payloads",
          "price_files", "snapshot_on_change", "positions", "pbo_splits", "cpcv", "delta_encode", "stream_daily_bars", "participant_files"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_reference_statement(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
    theirs = sorted([tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()], key=str)
    assert mine == theirs


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
