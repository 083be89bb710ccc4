import pytest
from helpers import day, days_from
from pyspark.sql import functions as F

from tickloom.operators import books as bk
from tickloom.operators import flows as fl
from tickloom.operators import membership as mb
from tickloom.operators import quality as qa

LEDGER = "book int, symbol string, date date, side string, qty bigint, value_cents bigint, cost_cents bigint"


def test_entitlement_and_share_actions(spark):
    led = spark.createDataFrame([(1, "A", day("2024-01-01"), "BUY", 13, 0, 0), (1, "A", day("2024-01-10"), "BUY", 5, 0, 0)], LEDGER)
    acts = spark.createDataFrame([("A", day("2024-01-10"), "dividend", 2.5, None)], "symbol string, ex_date date, kind string, value double, close double")
    out = bk.apply_actions(bk.held_on(led, acts)).first()
    assert out["held"] == 13 and out["cash"] == 32.5
    held = spark.createDataFrame([(13, "split", 0.2, None), (13, "bonus", 2 / 3, 66.0)], "held bigint, kind string, value double, close double")
    got = {r["kind"]: (r["added"], r["cash"]) for r in bk.apply_actions(held).collect()}
    assert got == {"split": (52, 0.0), "bonus": (6, 33.0)}


def test_settlement_compounds(spark):
    led = spark.createDataFrame([(1, "A", day("2024-01-01"), "BUY", 10, 0, 0), (1, "A", day("2024-02-15"), "BUY", 1, 0, 0)], LEDGER)
    acts = spark.createDataFrame([("A", day("2024-02-01"), "split", 0.5, 5.0), ("A", day("2024-03-01"), "dividend", 2.0, None)], "symbol string, ex_date date, kind string, value double, close double")
    got = [(r["held"], r["added"], r["cash"]) for r in bk.settle(led, acts).orderBy("ex_date").collect()]
    assert got == [(10, 10, 0.0), (21, 0, 42.0)]


def test_pending(spark):
    acts = spark.createDataFrame([("A", day("2024-01-01"), "dividend", 1.0), ("A", day("2024-01-02"), "split", 0.5), ("A", day("2025-01-01"), "bonus", 0.5), ("A", day("2024-01-01"), "rights", None)], "symbol string, ex_date date, kind string, value double")
    led = spark.createDataFrame([(1, "A", day("2024-01-01"), "DIVIDEND", 1, 0, 0)], LEDGER)
    assert [r["kind"] for r in bk.pending(acts, led, F.lit("2024-06-01").cast("date")).collect()] == ["split"]


def test_marks_and_late_restatement(spark):
    d = days_from("2024-01-01", 3)
    led = spark.createDataFrame([(1, "A", d[0], "BUY", 13, 130000, 0)], LEDGER)
    px = spark.createDataFrame([("A", d[0], 100.0), ("A", d[1], 100.0), ("A", d[2], 50.0)], "symbol string, date date, close double")
    days = spark.createDataFrame([(x,) for x in d], "date date")
    marks = bk.marks(led, px, days, 2800.0)
    assert [r["nav"] for r in marks.orderBy("date").collect()] == pytest.approx([2800, 2800, 2150])
    eff = spark.createDataFrame([(1, "A", d[1], 0, 26.0), (1, "A", d[2], 13, 0.0)], "book int, symbol string, ex_date date, added bigint, cash double")
    fixed = [r["nav"] for r in bk.restate(marks, eff, px).orderBy("date").collect()]
    assert fixed == pytest.approx([2800, 2826, 2150 + 26 + 13 * 50])
    gone = bk.marks(led, px.where(F.col("date") != F.lit(d[1])), days).where(F.col("date") == F.lit(d[1])).first()
    assert gone["nav"] is None and gone["missing"] == "A"


def test_order_sizing(spark):
    held = spark.createDataFrame([(1, "X", 100)], "book int, symbol string, position bigint")
    tg = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.3), (1, "C", 0.2)], "book int, symbol string, weight double")
    px = spark.createDataFrame([("A", 100.0), ("B", 50.0), ("C", 200.0), ("X", 10.0)], "symbol string, price double")
    rows = bk.order_sizing(held, tg, px, spark.createDataFrame([(1, 999_000.0)], "book int, cash double")).orderBy("side_order", "symbol").collect()
    assert [(r["symbol"], r["delta"]) for r in rows] == [("X", -100), ("A", 4990), ("B", 5988), ("C", 998)]


def test_set_changes(spark):
    s1, s2, s3 = day("2024-01-01"), day("2024-02-01"), day("2024-03-01")
    rows = [("i", s1, "a"), ("i", s1, "b"), ("i", s2, "b"), ("i", s2, "a"), ("i", s3, "b"), ("i", s3, "c")]
    m = spark.createDataFrame(rows, "index string, snapshot date, symbol string")
    assert sorted(r["snapshot"] for r in mb.changed_snapshots(m, ["symbol"]).collect()) == [s1, s3]
    got = {r["snapshot"]: (r["entered"], r["left"]) for r in mb.entries_and_exits(m).collect()}
    assert got == {s2: (0, 0), s3: (1, 1)}


def test_list_validation(spark):
    rows = [("i", "a", "INE000000001"), ("i", "b", "INE000000002"), ("d", "a", "INE000000001"), ("d", "a", "INE000000001"), ("m", "a", "X"), ("m", "b", "INE000000002")]
    df = spark.createDataFrame(rows, "index string, symbol string, isin string")
    got = {r["index"]: r["reason"] for r in mb.validate_lists(df, {"i": 2, "d": 2, "m": 2}).collect()}
    assert got == {"i": "", "d": "duplicate symbols", "m": "malformed ISINs"}
    assert mb.validate_lists(df.where("index = 'i'"), {"i": 3}).first()["reason"] == "size"


def test_balance_rejects_a_broken_day(spark):
    d1, d2, d3 = days_from("2024-01-01", 3)
    rows = []
    for d, tweak in ((d1, 0), (d2, 50), (d3, 0)):
        rows += [(d, "Client", 10.0 + tweak, 20.0), (d, "DII", 20.0, 10.0), (d, "FII", 5.0, 5.0), (d, "Pro", 5.0, 5.0), (d, "TOTAL", 40.0 + tweak if d != d3 else 99.0, 40.0)]
    out = {r["date"]: r["reason"] for r in fl.balance_failures(spark.createDataFrame(rows, "date date, participant string, l double, s double"), [("l", "s")]).collect()}
    assert out == {d1: "", d2: "long and short differ", d3: "participants do not sum to TOTAL"}


def test_date_convention_passes_only_when_the_flow_follows(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=100)
    d = days_from("2024-01-01", 100)
    rets = spark.createDataFrame([("m", a, float(b)) for a, b in zip(d, x)], "cid string, date date, ret double")
    late = spark.createDataFrame([(a, float(b)) for a, b in zip(d[1:], x[:-1])], "date date, flow double")
    same = spark.createDataFrame([(a, float(b)) for a, b in zip(d, x)], "date date, flow double")
    assert qa.date_convention(late, rets).first()["ok"] and not qa.date_convention(same, rets).first()["ok"]


def test_entitlements_are_not_shuffled(spark):
    led = spark.createDataFrame([(1, "A", day("2023-12-31"), "BUY", 13, 0, 0), (1, "A", day("2024-12-31"), "SELL", 3, 0, 0), (2, "A", day("2024-03-01"), "BUY", 4, 0, 0)], LEDGER)
    days = ["2023-12-31", "2024-01-01", "2024-12-31", "2024-12-31", "2025-01-01", "2027-05-05"]
    acts = spark.createDataFrame([("A", day(d), float(i)) for i, d in enumerate(days)] + [("B", day("2025-01-01"), 9.0)], "symbol string, ex_date date, value double")
    out = bk.held_on(led, acts)
    got = {book: [(r["value"], r["held"]) for r in out.where(F.col("book") == book).orderBy("value").collect()] for book in (1, 2)}
    assert got == {1: [(1, 13), (2, 13), (3, 13), (4, 10), (5, 10)], 2: [(2, 4), (3, 4), (4, 4), (5, 4)]}
    # every book meets every action: rows of that product are neither sorted nor exchanged
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan[:plan.index("Generate")] and "Window" not in plan[:plan.index("Generate")]


def test_settlement_without_shares_or_value(spark):
    led = spark.createDataFrame([(1, "A", day("2024-01-01"), "BUY", 1, 0, 0), (1, "A", day("2024-03-01"), "BUY", 5, 0, 0), (2, "A", day("2024-01-01"), "SELL", 2, 0, 0), (2, "A", day("2024-03-01"), "BUY", 9, 0, 0)], LEDGER)
    rows = [("2024-01-15", "rights", None, 3.0), ("2024-02-01", "consolidation", 2.0, 7.0), ("2024-02-02", "dividend", 1.5, None), ("2024-03-02", "dividend", 1.5, None), ("2024-03-02", "consolidation", 2.0, 7.0)]
    acts = spark.createDataFrame([("A", day(d), *r) for d, *r in rows], "symbol string, ex_date date, kind string, value double, close double")
    got = [(r["book"], r["kind"], r["held"], r["added"], r["cash"]) for r in bk.settle(led, acts).orderBy("book", "ex_date", "kind").collect()]
    assert got == [(1, "consolidation", 1, -1, 3.5), (1, "consolidation", 5, -3, 3.5), (1, "dividend", 2, 0, 3.0), (2, "consolidation", 7, -4, 3.5), (2, "dividend", 3, 0, 4.5)]


def test_positions_of_one_task_do_not_grow(spark, monkeypatch):
    rows = [(b, s, d, "BUY", 1, 100, 0) for b in range(20) for s in "AB" for d in days_from("2024-01-01", 5)]
    led = spark.createDataFrame(rows, LEDGER)
    days = spark.createDataFrame([(x,) for x in days_from("2024-01-01", 5)], "date date")
    px = days.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("symbol"), "date", F.lit(2.0).alias("close"))
    monkeypatch.setattr(bk, "DEALT", 20)
    assert bk.dealt(led).rdd.getNumPartitions() == 11
    out = bk.marks(led, px, days)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["date"].day, r["nav"]) for r in out.collect()} == {(i, 2.0 * i) for i in range(1, 6)}
