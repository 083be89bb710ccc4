import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from helpers import day, days_from
from pyspark.sql import functions as F

from tickloom.functions import costs
from tickloom.operators import backtest as bt
from tickloom.operators import gates, overfit, splits


def test_cost_schedule(spark):
    d = ["2023-03-31", "2023-04-01", "2024-10-01", "2026-04-01", "2000-01-01"]
    df = spark.createDataFrame([(i, day(x)) for i, x in enumerate(d)], "i int, d date")
    got = [r["s"]["sell"] for r in df.orderBy("i").select(costs.in_force(costs.TAX_SCHEDULE["futures"], F.col("d")).alias("s")).collect()]
    assert got == [0.0001, 0.000125, 0.0002, 0.0005, 0.0001]


def replay(px, targets, lag=1, cash=0.0, adv=None, spread=2e-4, capital=1e6, k=0.7):
    """One trial as an account of units and cash: bought and sold at closes, costs paid from the account."""
    n, m = px.shape
    rets = np.nan_to_num(np.diff(px, axis=0, prepend=px[:1]) / np.vstack([px[:1], px[:-1]]))
    price = np.cumprod(1 + rets, axis=0)  # a day without a price neither gains nor loses, nor does the next
    fee = (costs.EXCHANGE["delivery"] + costs.REGULATOR) * 1.18
    units, purse, worth = np.zeros(m), 1.0, 1.0
    net, gross, turn = [], [], []
    orders = {at + lag: goal for at, goal in targets.items()}
    for i in range(n):
        if i:
            purse *= (1 + cash) ** (1 / 252)
        value = purse + units @ price[i]
        gross.append(value / worth - 1)
        moved = 0.0
        if i in orders:
            bought = orders[i] * value - units * price[i]
            paid = spread * np.abs(bought).sum() + (fee + 0.00115) * bought.clip(min=0).sum() + (fee + 0.001) * (-bought).clip(min=0).sum()
            if adv is not None:
                at = max(i, 20)
                vol = rets[max(0, at - 63):at].std(axis=0, ddof=1)
                paid += np.nansum(np.abs(bought) * k * vol * np.sqrt(np.abs(bought) * capital / adv[i - 1]))
            moved, value = np.abs(bought).sum() / value / 2, value - paid
            units, purse = orders[i] * value / price[i], value * (1 - orders[i].sum())
        net.append(value / worth - 1)
        turn.append(moved)
        worth = value
    return np.array(gross), np.array(net), np.array(turn)


def test_returns_equal_the_daily_recursion(spark):
    rng = np.random.default_rng(11)
    n, m = 160, 3
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (n, m)), axis=0))
    px[rng.random((n, m)) < 0.05] = np.nan
    px[:, 0] = np.where(np.isnan(px[:, 0]), 100.0, px[:, 0])
    adv = rng.uniform(1e6, 5e6, (n, m))
    dates = days_from("2024-01-01", n)
    plans = {"t1": {p: rng.dirichlet(np.ones(m)) * 0.9 for p in (3, 40, 41, 100)}, "t2": {10: np.array([1.0, 0, 0]), 158: np.array([0, 1.0, 0]), 159: np.array([0, 0, 1.0])}}
    prices = spark.createDataFrame([(f"a{j}", dates[i], float(px[i, j])) for i in range(n) for j in range(m) if not np.isnan(px[i, j])], "asset string, date date, close double")
    value = spark.createDataFrame([(f"a{j}", dates[i], float(adv[i, j])) for i in range(n) for j in range(m)], "asset string, date date, adv double")
    targets = spark.createDataFrame([(t, dates[p], f"a{j}", float(w[j])) for t, plan in plans.items() for p, w in plan.items() for j in range(m)], "trial string, decision_date date, asset string, weight double")
    out = bt.target_weight_returns(prices, targets, cash_rate=0.05, adv=value).orderBy("trial", "date").collect()
    for t, plan in plans.items():
        gross, net, turn = replay(px, plan, cash=0.05, adv=adv)
        rows = [r for r in out if r["trial"] == t]
        assert len(rows) == n
        assert [r["gross"] for r in rows] == pytest.approx(gross, abs=1e-12)
        assert [r["net"] for r in rows] == pytest.approx(net, abs=1e-12)
        assert [r["turnover"] for r in rows] == pytest.approx(turn, abs=1e-12)
    with pytest.raises(ValueError):
        bt.target_weight_returns(prices, targets, lag=0)


def test_after_tax_carries_losses(spark):
    dates = [day("2020-03-30"), day("2020-03-31"), day("2021-03-31"), day("2022-03-31")]
    r = [0.0, -0.10, 0.20, 0.10]
    df = spark.createDataFrame([("t", d, x) for d, x in zip(dates, r)], "trial string, date date, net double")
    got = [x["ret"] for x in bt.after_tax(df).orderBy("date").collect()]
    # FY20 loses 100,000; FY21 gains 180,000, 80,000 taxed at 15%; FY22 taxed in full
    e1 = 900_000 * 1.2
    tax = 80_000 * 0.15
    assert got[:2] == [0.0, pytest.approx(-0.1)]
    assert got[2] == pytest.approx(1.2 * (1 - tax / e1) - 1)
    assert got[3] == pytest.approx(1.1 * (1 - (0.1 * 0.15) / 1.1) - 1)


def trials_frame(spark, m):
    dates = days_from("2020-01-01", m.shape[0])
    return spark.createDataFrame([(j, d, float(m[i, j])) for i, d in enumerate(dates) for j in range(m.shape[1])], "trial int, date date, ret double")


def test_psr_dsr_haircut_against_formulas(spark):
    m = np.random.default_rng(12).normal(0.0005, 0.01, (500, 4))
    mom = overfit.sharpe_moments(trials_frame(spark, m), ["trial"])
    rows = {r["trial"]: r for r in overfit.min_track_record(overfit.haircut_sharpe(overfit.deflated_sharpe(mom), F.lit(4)), F.lit(0.0)).collect()}
    nd = NormalDist()
    srs = m.mean(0) / m.std(0, ddof=1)
    a, b = nd.inv_cdf(1 - 1 / 4), nd.inv_cdf(1 - 1 / (4 * math.e))
    sr0 = math.sqrt(np.var(srs, ddof=1)) * ((1 - overfit.EULER_GAMMA) * a + overfit.EULER_GAMMA * b)
    for j in range(4):
        x = m[:, j]
        z = (x - x.mean()) / x.std()
        g3, g4, sr = (z**3).mean(), (z**4).mean(), srs[j]
        den = math.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr**2)
        assert rows[j]["dsr"] == pytest.approx(nd.cdf((sr - sr0) * math.sqrt(499) / den))
        t = sr * math.sqrt(252) * math.sqrt(500 / 252)
        p = 2 * (1 - nd.cdf(abs(t)))
        assert rows[j]["p"] == pytest.approx(p)
        if sr > 0:
            assert rows[j]["min_track_record"] == pytest.approx(1 + den**2 * (nd.inv_cdf(0.95) / sr) ** 2)
        else:
            assert rows[j]["min_track_record"] is None


def test_pbo_equals_brute_force(spark):
    m = np.random.default_rng(13).normal(0, 0.01, (103, 5))
    m[:, 4] = m[:, 3]
    blocks, n = 6, 5
    edges = np.linspace(0, 103, blocks + 1).astype(int)
    logits = []
    for combo in itertools.combinations(range(blocks), 3):
        inside = np.concatenate([np.arange(edges[b], edges[b + 1]) for b in combo])
        out = np.setdiff1d(np.arange(103), inside)
        i, o = [m[x].mean(0) / m[x].std(0, ddof=1) for x in (inside, out)]
        best = int(np.argmax(np.round(i, 12)))
        rank = (np.round(o, 12) < round(o[best], 12)).sum() + ((np.round(o, 12) == round(o[best], 12)).sum() + 1) / 2
        logits.append(math.log(rank / (n + 1) / (1 - rank / (n + 1))))
    got = overfit.pbo(trials_frame(spark, m), blocks).first()
    assert got["n_splits"] == 20 and got["pbo"] == pytest.approx(np.mean(np.array(logits) <= 0))
    rows = overfit.pbo_splits(trials_frame(spark, m), blocks).collect()
    assert sorted(r["logit"] for r in rows) == pytest.approx(sorted(logits))


def test_cross_validation_purges(spark):
    n, horizon, groups = 120, 5, 6
    rows = splits.with_horizon(spark.range(n).select(F.col("id").alias("session_no")), horizon)
    out = splits.combinatorial(rows, groups, 2, 0.02).collect()
    le = np.minimum(np.arange(n) + horizon, n - 1)
    parts = np.array_split(np.arange(n), groups)
    want = {}
    for s, combo in enumerate(itertools.combinations(range(groups), 2)):
        test = np.concatenate([parts[g] for g in combo])
        for i in range(n):
            role = "test" if i in test else "train"
            for g in combo:
                t0, t1 = parts[g].min(), parts[g].max()
                if role == "train" and ((i < t0 <= le[i]) or (t1 < i <= le[parts[g]].max() + round(n * 0.02))):
                    role = "purged"
            want[s, i] = role
    assert {(r["split"], r["session_no"]): r["role"] for r in out} == want
    assert len({r["split"] for r in out}) == 15


def test_uneven_groups_and_walk_forward(spark):
    rows = splits.with_horizon(spark.range(13).select(F.col("id").alias("session_no")), 0)
    b = [(r["t0"], r["t1"]) for r in splits.group_bounds(rows, 5).orderBy("g").collect()]
    assert b == [(int(p.min()), int(p.max())) for p in np.array_split(np.arange(13), 5)]
    wf = splits.walk_forward(rows, 6, 3, expanding=False).collect()
    assert sorted({r["fold"] for r in wf}) == [0, 1] and [r["session_no"] for r in wf if r["fold"] == 1 and r["role"] == "train"] == list(range(3, 9))
    assert splits.walk_forward(rows, 10, 10).count() == 0


def test_sensitivity(spark):
    grid = [("plateau", i, v) for i, v in enumerate([0.5, 0.6, 0.62, 0.6, 0.55])] + [("peak", i, v) for i, v in enumerate([0.1, 0.1, 0.8, 0.1, 0.1])] + [("short", 0, 1.0), ("loss", 0, -1.0), ("loss", 1, -2.0), ("loss", 2, -1.5)]
    got = {r["experiment"]: r for r in gates.sensitivity(spark.createDataFrame(grid, "experiment string, param int, metric double")).collect()}
    assert got["plateau"]["ok"] and not got["peak"]["ok"] and got["short"]["ok"] is None and got["loss"]["ok"] is False
    assert got["plateau"]["neighbour_ratio"] == pytest.approx(0.6 / 0.62) and got["loss"]["neighbour_ratio"] is None


def test_gate_report(spark):
    df = spark.createDataFrame([("e", 0.99, 0.2, 0.5, None, 300.0)], "experiment string, dsr double, pbo double, neighbour_ratio double, capacity double, min_track_record double")
    got = {r["n"]: r["status"] for r in gates.gate_report(df).collect()}
    assert got == {5: "PASS", 7: "FAIL", 8: "NOT RUN", 9: "INFO", 10: "NOT RUN"}


def test_losses_lapse_after_eight_years_and_over_idle_years(spark):
    years = [(2001, -0.5), (2002, -0.1), (2009, 0.2), (2010, 0.5), (2030, -0.3), (2042, 1.0)]
    df = spark.createDataFrame([("t", day(f"{y}-02-01"), r) for y, r in years], "trial string, date date, net double")
    got = [x["ret"] for x in bt.after_tax(df).orderBy("date").collect()]
    equity, carry, want = 1_000_000.0, {}, []
    for y, r in years:
        opening, equity = equity, equity * (1 + r)
        gain = equity - opening
        for old in sorted(carry):
            if gain > 0 and y - old <= 8:
                used = min(carry[old], gain)
                carry[old], gain = carry[old] - used, gain - used
        if gain < 0:
            carry[y] = -gain
        hit = max(gain, 0) * (0.20 if y >= 2025 else 0.15) / equity
        want.append((1 + r) * (1 - hit) - 1)
        equity *= 1 - hit
    assert got == [pytest.approx(w, abs=1e-12) for w in want] and want[2] == pytest.approx(0.2)
