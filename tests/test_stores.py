"""Incremental stores: what is written, and what is left alone."""

import datetime as dt
import os

from helpers import day, days_from

from tickloom.operators import membership as mb
from tickloom.operators import splits
from tickloom.sources import normalise as nz
from tickloom.sources import store as st


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_only_years_that_gain_days(spark, tmp_path):
    root = str(tmp_path / "years")
    schema = "symbol string, series string, date date, close double"
    old = [("A", "EQ", day(x), 1.0) for x in ("2022-12-29", "2022-12-30", "2023-01-02", "2024-01-02")]
    st.write_years(spark.createDataFrame(old, schema), root)
    before = files(root)
    new = spark.createDataFrame([("A", "EQ", d, 2.0) for d in days_from("2022-12-28", 12)], schema)
    holidays = spark.createDataFrame([(day("2023-01-06"),)], "date date")
    bounds = spark.createDataFrame([(day("2022-12-29"), day("2023-01-31"))], "start date, end date")
    gained = {r["year"]: r["days"] for r in st.upsert_years(root, new, holidays, bounds).collect()}
    assert gained == {2023: 3}
    after = files(root)
    assert {f: t for f, t in before.items() if "2023" not in f} == {f: t for f, t in after.items() if "2023" not in f}
    rows = {r["date"].isoformat(): r["close"] for r in spark.read.parquet(root).collect()}
    assert rows == {"2022-12-29": 1.0, "2022-12-30": 1.0, "2023-01-02": 1.0, "2023-01-03": 2.0, "2023-01-04": 2.0, "2023-01-05": 2.0, "2024-01-02": 1.0}
    assert st.upsert_years(root, new, holidays, bounds).count() == 0 and files(root) == after


def test_rebuild_reads_only_changed_partitions(spark, tmp_path):
    raw, curated = str(tmp_path / "raw"), str(tmp_path / "curated")
    land = lambda part, v: spark.createDataFrame([(part, v)], "part string, v int").write.mode("append").partitionBy("part").parquet(raw)
    build = lambda df: df.groupBy("part").sum("v").withColumnRenamed("sum(v)", "v")
    land("a", 1), land("b", 2)
    assert st.rebuild_changed(spark, raw, curated, "part", build) == ["a", "b"]
    before = files(curated)
    land("b", 5), land("c", 1)
    assert st.rebuild_changed(spark, raw, curated, "part", build) == ["b", "c"]
    assert st.rebuild_changed(spark, raw, curated, "part", build) == []
    assert {f: t for f, t in files(curated).items() if "part=a" in f} == {f: t for f, t in before.items() if "part=a" in f}
    assert {r["part"]: r["v"] for r in spark.read.parquet(curated).collect()} == {"a": 1, "b": 7, "c": 1}


def test_backdated_versions_find_their_place(spark):
    def lists(versions):
        rows = [("i", day(d), s, s) for d, names in versions.items() for s in names]
        return mb.set_digests(spark.createDataFrame(rows, "index string, snapshot date, symbol string, isin string"), ["symbol", "isin"])

    stored = lists({"2024-01-01": "ab", "2024-06-01": "bc", "2024-09-01": "cd"})
    late = lists({"2023-12-01": "ab", "2024-02-01": "ba", "2024-03-01": "bcb", "2024-04-01": "bc", "2024-06-01": "xy", "2024-10-01": "dc"})
    kept = mb.new_versions(stored, late)
    assert sorted(r["snapshot"].isoformat() for r in kept.collect()) == ["2023-12-01", "2024-03-01"]
    twice = mb.redundant_versions(stored.unionByName(kept))
    assert sorted(r["snapshot"].isoformat() for r in twice.collect()) == ["2024-01-01", "2024-06-01"]


def test_curated_tables_need_no_exchange(spark):
    from tickloom.operators import series as ser

    bars = spark.createDataFrame([(c, d, float(i + 1)) for c in "abc" for i, d in enumerate(days_from("2024-01-01", 30))], "cid string, date date, close double")
    table = st.save_curated(bars, "some_bars", buckets=4)
    out = ser.log_returns(table, calendar="own")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.count() == 87
    assert st.read_curated(spark, "some_bars", ["cid"]).columns == ["cid"]


def test_days_follow_the_local_clock(spark):
    at = [dt.datetime(2024, 3, 9, 11, 30), dt.datetime(2024, 3, 10, 4, 30), dt.datetime(2024, 3, 10, 5, 30), dt.datetime(2024, 3, 11, 3, 30), dt.datetime(2024, 3, 11, 4, 30)]
    raw = spark.createDataFrame([(k, t, float(i), 0.0, i, "x") for k in ("nz", "ny", "utc") for i, t in enumerate(at)], "key string, date timestamp, close double, volume double, seq int, other string")
    zones = spark.createDataFrame([("nz", "Pacific/Auckland"), ("ny", "America/New_York"), ("utc", None)], "key string, zone string")
    out = nz.ohlcv(raw, zones=zones)
    assert out.columns == ["key", "date", "close", "volume"]
    rows = {(r["key"], r["date"].isoformat()[5:]): (r["close"], r["volume"]) for r in out.collect()}
    # Auckland is 13 hours ahead; New York goes from 5 to 4 hours behind on the tenth
    want = {("nz", "03-10"): 2.0, ("nz", "03-11"): 4.0, ("ny", "03-09"): 1.0, ("ny", "03-10"): 3.0, ("ny", "03-11"): 4.0, ("utc", "03-09"): 0.0, ("utc", "03-10"): 2.0, ("utc", "03-11"): 4.0}
    assert {k: v[0] for k, v in rows.items()} == want
    assert all(v is None for _, v in rows.values())


def test_lists_are_refused_whole_with_a_reason(spark):
    good = "Company Name,Industry,Symbol,Series,ISIN Code\r\n\"One, Ltd\",x, ONE ,EQ,IN0000000001\nTwo,y,TWO,EQ,IN0000000002\n\n"
    texts = {"good": good, "short": good, "page": "<html>", "none": None, "heads": "Company Name,Symbol\na,b", "twice": good.replace("TWO", "ONE"), "isin": good.replace("IN0000000002", "XX1"),
             "line": good.replace("Two,y,TWO,EQ,IN0000000002", "Two,y,TWO"), "long": good.replace("Two,y,", "Two,y,z,"), "other": good}
    raw = spark.createDataFrame(list(texts.items()), "index string, text string")
    sizes = spark.createDataFrame([(k, 3 if k == "short" else 2) for k in texts if k != "other"], "index string, size long")
    rows, rejects = nz.constituent_lists(raw, sizes)
    assert sorted((r["index"], r["company"], r["symbol"], r["isin"]) for r in rows.collect()) == [("good", "One, Ltd", "ONE", "IN0000000001"), ("good", "Two", "TWO", "IN0000000002")]
    assert {r["index"]: r["reason"] for r in rejects.collect()} == {
        "short": "2 constituents, expected 3", "page": "not a constituent file", "none": "not a constituent file", "heads": "unexpected columns", "twice": "duplicate symbols",
        "isin": "malformed ISINs", "line": "malformed line", "long": "malformed line", "other": "unknown index"}


def test_label_ends_by_date(spark):
    days = [day(x) for x in ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-08", "2024-01-09")]
    rows = spark.createDataFrame(list(enumerate(days)), "session_no long, date date")
    ends = spark.createDataFrame([(days[0], day("2024-01-07")), (days[1], None), (days[2], day("2023-12-01")), (days[3], day("2030-01-01"))], "date date, label_end date")
    assert [r["label_end"] for r in splits.with_label_dates(rows, ends).orderBy("session_no").collect()] == [2, 4, 2, 4, 4]
