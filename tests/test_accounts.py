"""Accounts bar by bar against a plain loop, and the rules of adding to a position one by one."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import trades
from tidebar.operators.strategy import BASE, STYLES

ROW = "symbol string, date date, i long, high double, low double, close double, limit_down boolean, c0 struct<entry:double,stop:double,target:double,position_pct:double,signal_type:string,confidence:double>"


def series(n, seed, every, sigma=0.02, drift=0.001, symbol="s", pct=0.3):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price *= 1 + drift + rng.gauss(0, sigma)
        c = (price * 1.0013, price * (1 - rng.uniform(0.02, 0.08)), price * (1 + rng.uniform(0.03, 0.2)), pct, "t", 0.5) if i and rng.random() < every else None
        rows.append((symbol, datetime.date(2022, 1, 3) + datetime.timedelta(days=i), i, price * (1 + rng.random() * 0.02), price * (1 - rng.random() * 0.02), price, rng.random() < 0.04, c))
    return rows


def rounded(x, places=3):
    return math.floor((x + 1e-9) * 10**places + 0.5) / 10**places


def loop(rows, p, risk, capital=100_000.0):
    """One account in plain Python."""
    cash, h, out, peak, broken, losses, pause = capital, None, [], capital, False, 0, 0

    def close(x, raw, why):
        nonlocal cash, h, losses, pause
        net = rounded(raw - raw * (p.commission + p.stamp_tax))
        cash += h["quantity"] * net
        out.append((h["i"], h["quantity"], h["adds"], round(h["entry"], 6), x[2], round(raw, 6), net, why, round(cash, 4)))
        losses = losses + 1 if net < h["entry"] else 0
        if net < h["entry"] and losses >= (risk.losses if risk else 99):
            pause = risk.pause
        h = None

    for x in rows:
        _, _, i, high, low, price, down, c = x
        if h and not down and i - h["i"] >= 3:
            h["top"] = max(h["top"], high)
            profit = (price - h["entry"]) / h["entry"]
            h["trails"] = h["trails"] or profit >= p.trail_activation
            trail = h["top"] * (1 - p.trail_pct)
            if low <= h["stop"]:
                close(x, h["stop"], "stop_loss")
            elif i - h["i"] >= p.max_holding_days:
                close(x, price, "time_exit")
            elif h["trails"] and low <= trail:
                close(x, trail, "trailing_stop")
            elif price >= h["target"]:
                close(x, price, "target_reached")
            elif profit >= p.breakeven_pct and h["stop"] < h["entry"]:
                h["stop"] = h["entry"]
        if not h and c and not (risk and (broken or pause)):
            lots = int(cash * c[3] / c[0] / 100) * 100
            if lots >= 100 and lots * c[0] <= cash:
                cash -= lots * c[0]
                h = {"i": i, "entry": c[0], "stop": c[1], "target": c[2], "quantity": lots, "top": c[0], "trails": False, "adds": 0}
        if risk:
            total = cash + (h["quantity"] * price if h else 0)
            peak = max(peak, total)
            broken = broken or (peak - total) / peak >= risk.break_drawdown
            pause = max(0, pause - 1)
            if h and not broken and not pause and h["adds"] < risk.most_adds and (price - h["entry"]) / h["entry"] >= risk.add_gain:
                cost = price * (1 + p.commission + p.slippage)
                lots = int(max(h["quantity"] * h["entry"] * risk.add_share, price * 110) / cost / 100) * 100
                if lots >= 100 and lots * cost <= cash:
                    average = (h["quantity"] * h["entry"] + lots * cost) / (h["quantity"] + lots)
                    cash -= lots * cost
                    h |= {"entry": rounded(average), "stop": rounded(average * (1 - p.min_stop_pct)), "quantity": h["quantity"] + lots, "adds": h["adds"] + 1}
    if h:
        close(rows[-1], rows[-1][5], "end_of_backtest")
    return out


def traded(states):
    t = trades.account_trades(states).orderBy("exit_i", "i").collect()
    return [(r["i"], r["quantity"], r["adds"], round(r["entry"], 6), r["exit_i"], round(r["exit_raw"], 6), r["exit_price"], r["exit_reason"], round(r["cash_out"], 4)) for r in t]


@pytest.mark.parametrize("risk", [None, trades.Risk(), trades.Risk(most_adds=3, add_gain=0.02, break_drawdown=0.04, losses=2, pause=9)])
def test_accounts_equal_a_loop(spark, risk):
    grown = 0
    for seed, p in ((1, BASE), (2, STYLES[0]), (3, STYLES[2])):
        rows = series(230, seed, 0.3, sigma=0.012 + seed * 0.004, drift=0.002)
        want = loop(rows, p, risk)
        assert traded(trades.accounts(spark.createDataFrame(rows, ROW), [p], risk=risk)) == sorted(want, key=lambda r: (r[4], r[0]))
        grown += sum(r[2] for r in want)
        assert len(want) >= 3
    assert (grown > 0) == (risk is not None)


def test_account_equals_ledger_of_first_exits(spark):
    rows = series(300, 7, 0.4) + series(140, 8, 0.5, symbol="z") + series(2, 9, 1.0, symbol="y")
    df = spark.createDataFrame(rows, ROW)
    own = trades.account_trades(trades.accounts(df)).select("symbol", "i", "exit_i", "quantity", F.round("cash_out", 6), F.round("pnl", 6), "exit_reason")
    paths = trades.ledger(trades.exits(df)).select("symbol", "i", "exit_i", "quantity", F.round("cash_out", 6), F.round("pnl", 6), "exit_reason")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, paths.collect()))


def test_presets_share_one_pass(spark):
    rows = spark.createDataFrame(series(200, 4, 0.3), ROW)
    both = trades.accounts(rows.withColumn("c1", F.col("c0")), [STYLES[0], STYLES[2]])
    assert traded(both.where("style = 'short_term'")) == traded(trades.accounts(rows, [STYLES[0]]))
    assert traded(both.where("style = 'medium_term'")) == traded(trades.accounts(rows, [STYLES[2]]))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def bar(i, price, low=None, c=None, down=False):
    return ("x", datetime.date(2023, 1, 1) + datetime.timedelta(days=i), i, price, low or price, price, down, c)


def position(spark, later, pct=0.15, risk=trades.Risk()):
    rows = [bar(0, 100.0), bar(1, 100.0, c=(100.0, 94.0, 150.0, pct, "t", 0.75)), *[bar(k + 2, p) for k, p in enumerate(later)]]
    return trades.accounts(spark.createDataFrame(rows, ROW), risk=risk)


def last(states):
    return states.orderBy(F.desc("i")).first()


def test_adds_above_the_threshold_and_not_below(spark):
    assert last(position(spark, [106.0]))["h"]["adds"] == 1
    assert last(position(spark, [103.0]))["h"]["adds"] == 0


def test_adds_are_limited_and_move_average_and_stop(spark):
    h = last(position(spark, [106.0, 113.0]))["h"]
    price = 106.0 * 1.0013
    assert h["adds"] == 1 and h["quantity"] == 200 and h["entry"] == pytest.approx((100 * 100 + 100 * price) / 200, abs=1e-3)
    assert h["stop"] == pytest.approx(h["entry"] * (1 - BASE.min_stop_pct), abs=1e-3)


def test_an_add_must_be_affordable(spark):
    h = last(position(spark, [106.0], pct=0.99))
    assert h["h"]["adds"] == 0 and h["cash"] < 106 * 100


def test_the_breaker_stops_adds_and_entries(spark):
    rows = [bar(0, 100.0), bar(1, 100.0, c=(100.0, 50.0, 150.0, 0.9, "t", 0.7)), bar(2, 85.0), bar(3, 106.0, low=86.0), bar(4, 40.0), *[bar(k, 100.0, c=(100.0, 90.0, 120.0, 0.2, "t", 0.7)) for k in range(5, 9)]]
    s = trades.accounts(spark.createDataFrame(rows, ROW), risk=trades.Risk())
    assert last(s)["broken"] and last(s)["h"] is None and [r["adds"] for r in trades.account_trades(s).collect()] == [0]


def test_rows_without_candidates_or_bars(spark):
    assert trades.account_trades(trades.accounts(spark.createDataFrame(series(30, 1, 0.0), ROW))).collect() == []
    assert trades.accounts(spark.createDataFrame([], ROW)).collect() == []
    assert trades.exits(spark.createDataFrame([], ROW)).collect() == []


def test_accounts_walk_the_sorted_bars_in_batches(spark):
    rows = series(90, 5, 0.4) + series(61, 6, 0.4, symbol="z") + series(1, 7, 1.0, symbol="a")
    shuffled = random.Random(3).sample(rows, len(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        states = trades.accounts(spark.createDataFrame(shuffled, ROW), risk=trades.Risk())
        got = traded(states)
        plan = states._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [t for s in "saz" for t in loop([r for r in rows if r[0] == s], BASE, trades.Risk())]
    assert sorted(got) == sorted(want) and len(want) >= 3
    assert "Aggregate" not in plan


def test_a_bar_without_prices_closes_nothing(spark):
    rows = [bar(0, 100.0), bar(1, 100.0, c=(100.0, 94.0, 150.0, 0.15, "t", 0.75)), *[bar(k, None) for k in range(2, 7)], bar(7, 93.0)]
    t = trades.account_trades(trades.accounts(spark.createDataFrame(rows, ROW))).collect()
    assert [(r["i"], r["exit_i"], r["exit_reason"]) for r in t] == [(1, 7, "stop_loss")]
