import math

import numpy as np
import pandas as pd
import pytest
from helpers import column, day, days_from
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import relations as rel
from tickloom.operators import series as ser


def test_drawdown(bars):
    got = column(ser.drawdown(bars([100, 110, 99, 120, 90])), "drawdown")
    assert got == pytest.approx([0, 0, -0.1, 0, -0.25])


def test_trailing_percentile_rising_and_falling(bars):
    up = column(ser.trailing_percentile(bars(range(1, 121)), "close", 100, 50), "pct")
    down = column(ser.trailing_percentile(bars(range(120, 0, -1)), "close", 100, 50), "pct")
    assert set(up) == {1.0}
    assert down[0] == pytest.approx(1 / 50) and down[-1] == pytest.approx(0.01)


def test_period_returns(bars):
    b = bars([100, 110, 120, 132], dates=[day("2025-12-31"), day("2026-08-28"), day("2026-09-23"), day("2026-09-30")])
    r = ser.period_returns(b).first()
    assert r["as_of"] == day("2026-09-30")
    assert r["d1"] == r["w1"] == pytest.approx(132 / 120 - 1)
    assert r["m1"] == pytest.approx(132 / 110 - 1)
    assert r["m3"] == r["ytd"] == pytest.approx(0.32) and r["y1"] is None


def test_own_as_of_date(bars):
    both = bars([1, 2, 3]).union(bars([1, 2], cid="b"))
    assert {r["cid"]: r["as_of"] for r in ser.period_returns(both).collect()} == {"a": day("2024-01-03"), "b": day("2024-01-02")}


def test_summary(bars):
    r = ser.summary_stats(bars([100, 200, 100], dates=[day("2020-01-01"), day("2021-01-01"), day("2022-01-01")])).first()
    assert r["max_drawdown"] == pytest.approx(-0.5) and r["cagr"] == pytest.approx(0) and r["n_obs"] == 3


def test_summary_moments_match_pandas(bars):
    x = np.random.default_rng(1).normal(0, 0.02, 300)
    px = 100 * np.exp(np.cumsum(x))
    r = ser.summary_stats(bars(px)).first()
    ret = pd.Series(np.log(px)).diff().dropna()
    assert r["skew"] == pytest.approx(ret.skew()) and r["excess_kurtosis"] == pytest.approx(ret.kurt())
    assert r["ann_vol"] == pytest.approx(ret.std() * math.sqrt(252))


def test_rebase(bars):
    a = bars([10, 20, 40], start="2024-01-03")
    b = bars([5, 10], start="2024-01-04", cid="b")
    got = {(r["cid"], str(r["date"])): r["rebased"] for r in ser.rebase(a.union(b)).collect()}
    assert got == {("a", "2024-01-04"): 100, ("b", "2024-01-04"): 100, ("a", "2024-01-05"): 200, ("b", "2024-01-05"): 200}


def test_returns_are_not_filled_across_panel_gaps(bars):
    panel = bars([1, None, 2, 4]).union(bars([1, 1, 1, 1], cid="b"))
    assert column(ser.log_returns(panel).where("cid = 'a'"), "ret") == pytest.approx([math.log(2)])
    assert len(column(ser.log_returns(panel, calendar="own").where("cid = 'a'"), "ret")) == 2


def test_rolling_corr_of_a_series_with_itself_and_its_negative(spark, bars):
    x = np.random.default_rng(0).normal(size=80)
    s = bars(x).union(bars(x, cid="b")).union(bars(-x, cid="c")).withColumnRenamed("close", "ret")
    out = rel.rolling_corr(s, [("a", "b"), ("a", "c")], 60)
    assert out.where("b = 'b'").agg(F.min("corr")).first()[0] == pytest.approx(1)
    assert out.where("b = 'c'").agg(F.max("corr")).first()[0] == pytest.approx(-1)


def test_lead_lag_peak_and_hac(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = np.roll(x, 2)
    rows = [("p", d, float(a), float(b)) for d, a, b in zip(days_from("2024-01-01", 200), x, y)][2:]
    pairs = spark.createDataFrame(rows, "k string, date date, x double, y double")
    out = {r["lag"]: r for r in rel.lead_lag(pairs, ["k"]).collect()}
    assert max(out, key=lambda k: out[k]["corr"]) == 2 and out[2]["corr"] == pytest.approx(1)
    # brute force at lag 1
    xs, ys = np.array([r[2] for r in rows])[:-1], np.array([r[3] for r in rows])[1:]
    n = len(xs)
    u = (xs - xs.mean()) / xs.std()
    v = (ys - ys.mean()) / ys.std()
    beta = u @ v / (u @ u)
    e = u * (v - beta * u)
    lags = int(np.floor(4 * (n / 100) ** (2 / 9)))
    s = e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    assert out[1]["t_hac"] == pytest.approx(out[1]["corr"] / (math.sqrt(s) / (u @ u)))


def test_regime_quantiles(bars):
    labels = [r["regime"] for r in ser.regime_labels(bars(range(1, 101)), "close").orderBy("date").collect()]
    assert labels[0] == "calm" and labels[70] == "elevated" and labels[-1] == "stress"
    assert labels.count("stress") in (10, 11)


def test_expanding_regimes_do_not_look_ahead(bars):
    x = np.random.default_rng(3).normal(size=400)
    short = {r["date"]: r["regime"] for r in ser.regime_labels_expanding(bars(x[:300]), "close").collect()}
    long = {r["date"]: r["regime"] for r in ser.regime_labels_expanding(bars(x), "close").collect()}
    assert short and all(long[d] == v for d, v in short.items())


def test_week_label(spark):
    days = spark.createDataFrame([(day("2024-01-05"),), (day("2024-01-06"),), (day("2024-01-08"),)], "date date")
    assert column(days.select("date", cal.week_ending_friday(F.col("date")).alias("w")), "w") == [day("2024-01-05"), day("2024-01-12"), day("2024-01-12")]


def test_break_gaps(bars):
    b = bars([1, 2, 3], dates=[day("2024-01-01"), day("2024-01-02"), day("2024-01-20")])
    out = [(str(r["date"]), r["close"]) for r in ser.break_gaps(b).orderBy("date").collect()]
    assert out == [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-19", None), ("2024-01-20", 3.0)]


def test_cumulative_spans_years(bars):
    b = bars([1, 2, 3], dates=[day("2023-12-30"), day("2023-12-31"), day("2024-01-01")])
    assert column(ser.cumulative(b, "close"), "cum") == [1, 3, 6]


def test_keep_last_takes_the_latest_copy(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid")], "k string, seq int, v string")
    assert ser.keep_last(rows, ["k"], ["seq"]).first()["v"] == "new"


def test_adv_counts_untraded_days_as_zero(spark, bars):
    dates = days_from("2024-01-01", 130)
    a = spark.createDataFrame([("a", d, 10.0) for d in dates[::2]] + [("b", d, 1.0) for d in dates], "cid string, date date, turnover double")
    last = ser.average_turnover(a).where("cid = 'a'").orderBy(F.desc("date")).first()
    assert last["adv"] == pytest.approx(10.0 * sum(1 for i in range(0, 130, 2) if last["session_no"] - 125 <= i <= last["session_no"]) / 126)


def test_pair_sums_over_blocks_equal_a_library(spark):
    rng = np.random.default_rng(1)
    days = days_from("2023-12-28", 40)
    wide = pd.DataFrame(rng.normal(1000, 1, (40, 8)), index=days, columns=[f"k{i}" for i in range(8)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["flat"] = 7.0
    rows = [(k, d, float(v)) for k in wide for d, v in wide[k].items() if v == v]
    df = spark.createDataFrame(rows, "cid string, date date, ret double")
    found = {(r.a, r.b): (r.n, r["corr"]) for r in rel.pair_correlations(df, block=(3, 7)).collect()}
    assert set(found) == {(a, b) for a in wide for b in wide if a < b}
    for (a, b), (n, c) in found.items():
        both = wide[[a, b]].dropna()
        assert n == len(both) and (c is None if "flat" in (a, b) else c == pytest.approx(both[a].corr(both[b]), abs=1e-12))
    asked = spark.createDataFrame([("k5", "k1"), ("k0", "k7"), ("k1", "absent"), ("k2", "k1")], "a string, b string")
    some = {(r.a, r.b): (r.n, r["corr"]) for r in rel.pair_correlations(df, asked, block=(3, 7)).collect()}
    assert set(some) == {("k5", "k1"), ("k0", "k7"), ("k2", "k1")}
    assert all(v == (found[min(p), max(p)][0], pytest.approx(found[min(p), max(p)][1], abs=1e-12)) for p, v in some.items())
    assert {(r.a, r.b) for r in rel.all_pairs(df).collect()} == set(found)
    assert rel.pair_correlations(df.limit(0)).collect() == []


def test_expanding_labels_equal_a_library(bars):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 65, 200):
        v = pd.Series(np.round(rng.normal(10, 2, n), 1), index=days_from("2024-01-01", n))
        lo, hi = v.expanding(2).quantile(0.5), v.expanding(2).quantile(0.9)
        want = {d: "stress" if x >= hi[d] else "calm" if x <= lo[d] else "elevated" for d, x in v.items() if lo[d] == lo[d]}
        found = ser.regime_labels_expanding(bars(list(v)), "close", min_periods=2).collect()
        assert {r["date"]: r["regime"] for r in found} == want
