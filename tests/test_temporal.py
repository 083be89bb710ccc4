import random

import pytest
from helpers import column, day, days_from

from tickloom.functions import calendar as cal
from tickloom.operators import temporal as tmp
from tickloom.sources import store as st
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_equals_brute_force(spark, direction, strict):
    rng = random.Random(5)
    cal_days = days_from("2021-11-01", 900)
    facts = sorted({(k, rng.choice(cal_days)) for k in "abc" for _ in range(12)})
    facts = [(k, d, i) for i, (k, d) in enumerate(facts)]
    probes = [(rng.choice("abcd"), rng.choice(cal_days), i) for i in range(300)]
    out = tmp.asof(frame(spark, probes, "k string, d date, i int"), frame(spark, facts, "k string, t date, v int"), ["k"], "d", "t", ["v"], direction, strict)
    got = {r["i"]: r["v"] for r in out.collect()}
    assert len(got) == 300
    for k, d, i in probes:
        if direction == "backward":
            ok = [f for f in facts if f[0] == k and (f[1] < d if strict else f[1] <= d)]
            want = max(ok, key=lambda f: f[1])[2] if ok else None
        else:
            ok = [f for f in facts if f[0] == k and (f[1] > d if strict else f[1] >= d)]
            want = min(ok, key=lambda f: f[1])[2] if ok else None
        assert got[i] == want


def test_flow_redating_and_collisions(spark):
    trading = frame(spark, [(day("2026-09-28"),), (day("2026-09-29"),), (day("2026-10-02"),)], "date date")
    flow = frame(spark, [(day("2026-09-30"), 5.0), (day("2026-10-01"), 7.0)], "date date, flow double")
    assert [(str(r[0]), r[1]) for r in tmp.redate_flow(flow, trading).collect()] == [("2026-09-29", 12.0)]


def test_flow_before_the_first_day_is_dropped(spark):
    trading = frame(spark, [(day("2026-09-29"),), (day("2026-09-30"),)], "date date")
    flow = frame(spark, [(day("2026-09-29"), 1.0), (day("2026-09-30"), 2.0)], "date date, flow double")
    assert [(str(r[0]), r[1]) for r in tmp.redate_flow(flow, trading).collect()] == [("2026-09-29", 2.0)]


def test_lost_days(spark):
    trading = frame(spark, [(d,) for d in (day("2026-09-24"), day("2026-09-25"), day("2026-09-28"), day("2026-09-29"), day("2026-09-30"), day("2026-10-01"))], "date date")
    got = frame(spark, [(day("2026-09-25"),), (day("2026-09-29"),), (day("2026-09-30"),)], "date date")
    assert column(tmp.missing_between(got, trading), "date") == [day("2026-09-28")]


def test_renames_chain_and_reuse(spark):
    ren = frame(spark, [("A", "B", day("2010-01-01"), 1), ("B", "C", day("2015-01-01"), 2)], "old string, new string, date date, seq int")
    rows = frame(spark, [("A", day("2009-01-01"), 1), ("A", day("2012-01-01"), 2), ("B", day("2012-01-01"), 3), ("B", day("2016-01-01"), 4), ("Z", day("2012-01-01"), 5)], "symbol string, date date, i int")
    got = {r["i"]: r["cid"] for r in tmp.canonical_ids(rows, ren).collect()}
    assert got == {1: "C", 2: "A", 3: "C", 4: "B", 5: "Z"}


def test_renames_equal_sequential_replay(spark):
    rng = random.Random(9)
    days = days_from("2015-01-01", 400)
    ren = sorted({(rng.choice("ABCDE"), rng.choice("ABCDE"), d) for d in rng.sample(days, 30)}, key=lambda x: x[2])
    ren = [(o, n, d, i) for i, (o, n, d) in enumerate(ren) if o != n]
    rows = [(rng.choice("ABCDE"), rng.choice(days), i) for i in range(300)]
    out = tmp.canonical_ids(frame(spark, rows, "symbol string, date date, i int"), frame(spark, ren, "old string, new string, date date, seq int"))
    got = {r["i"]: r["cid"] for r in out.collect()}
    for sym, d, i in rows:
        for o, n, when, _ in ren:
            if sym == o and d < when:
                sym = n
        assert got[i] == sym


def test_vintage_reads(spark):
    rows = frame(spark, [("k", day("2026-09-01"), 1.0), ("k", day("2026-09-20"), 2.0)], "key string, snapshot date, v double")

    def at(d):
        return [r["v"] for r in st.read_vintage(rows, F.lit(d).cast("date") if d else None).collect()]

    assert at("2026-09-25") == [2.0] and at("2026-09-10") == [1.0] and at(None) == [2.0] and at("2026-08-01") == []


def test_splice(spark):
    cur = frame(spark, [("x", day("2026-09-01"), 100.0), ("y", day("2026-09-01"), 35089.80), ("z", day("2026-09-01"), 5.0)], "name string, date date, tri double")
    new = frame(spark, [("x", day("2026-09-01"), 100.0), ("x", day("2026-09-02"), 101.0), ("y", day("2026-09-01"), 17000.0), ("y", day("2026-09-02"), 1.0),
                        ("z", day("2026-09-03"), 6.0)], "name string, date date, tri double")
    add, refused = st.splice(cur, new)
    assert [(r["name"], r["tri"]) for r in add.collect()] == [("x", 101.0)]
    assert {r["name"]: r["reason"] for r in refused.collect()} == {"y": "overlap differs", "z": "no overlap day"}


def test_sessions_and_financial_year(spark):
    d = frame(spark, [(day("2024-03-31"),), (day("2024-04-01"),), (day("2024-04-01"),)], "date date")
    assert column(cal.number_sessions(d), "session_no") == [0, 1]
    assert column(d.distinct().select("date", cal.financial_year("date").alias("fy")), "fy") == [2024, 2025]


def test_trial_gate(spark):
    t = frame(spark, [("e", day("2024-01-01")), ("e", day("2025-01-01")), ("u", day("2024-01-01"))], "experiment string, data_end date")
    reg = frame(spark, [("e", day("2024-10-01"))], "experiment string, holdout_start date")
    ok, bad = st.gate_trials(t, reg, frame(spark, [], "experiment string"))
    assert ok.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["not registered", "touches the sealed holdout"]
    ok, bad = st.new_registrations(reg, frame(spark, [("e", "h"), ("n", "h")], "experiment string, hypothesis string"), ["hypothesis"])
    assert [r["experiment"] for r in ok.collect()] == ["n"] and bad.count() == 1
