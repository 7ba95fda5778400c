"""Fixtures with expectations worked out by hand or by plain loops."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import indicators, quality, registry, regime, trades
from tidebar.operators.strategy import BASE
from tidebar.sources import bars as src


def walk(n, seed, drift=0.0006, sigma=0.012, symbol="000001"):
    rng, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        old, price = price, price * (1 + drift + rng.gauss(0, sigma))
        rows.append((symbol, datetime.date(2022, 1, 3) + datetime.timedelta(days=k), old, max(old, price) * 1.008, min(old, price) * 0.992, price, 1e7 * (1 + 0.3 * abs(rng.gauss(0, 1))), 1e9))
    return pd.DataFrame(rows, columns=src.COLUMNS)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([walk(220, 1), walk(180, 2, symbol="688001")])).persist()


def test_recursive_series_equal_a_loop(spark, bars):
    got = indicators.recursive_indicators(bars.where("symbol = '000001'")).orderBy("date").toPandas()
    c = walk(220, 1)["close"].tolist()
    e12 = e26 = c[0]
    sig = 0.0
    for k, x in enumerate(c):
        if k:
            e12, e26 = e12 + (x - e12) * 2 / 13, e26 + (x - e26) * 2 / 27
            sig += (e12 - e26 - sig) * 0.2
        assert abs(got["ema12"][k] - e12) < 1e-9 and abs(got["signal"][k] - sig) < 1e-9
    assert got["rsi14"][0] == 50


def test_features_do_not_look_ahead(bars):
    cut = bars.where("date <= '2022-06-30'")
    whole = regime.detect(bars).where("date <= '2022-06-30'").orderBy("symbol", "date").collect()
    assert whole == regime.detect(cut).orderBy("symbol", "date").collect()


def test_short_history_has_the_default_regime(bars):
    r = regime.detect(bars).where("rn < 130").select("regime", "confidence", "max_position", "max_positions").distinct().collect()
    assert [tuple(x) for x in r] == [("structural", 0.3, 0.3, 2)]


def first_exit_loop(b, i, entry, stop, target, p, limit):
    top, safe, trails, at_stop = entry, False, False, stop
    for j in range(i + 3, len(b)):
        if b["close"][j] / b["close"][j - 1] - 1 <= -limit:
            continue
        top = max(top, b["high"][j])
        profit = (b["close"][j] - entry) / entry
        trails = trails or profit >= p.trail_activation
        at_stop = entry if safe and stop < entry else stop
        if b["low"][j] <= at_stop:
            return j, at_stop, "stop_loss"
        if j - i >= p.max_holding_days:
            return j, b["close"][j], "time_exit"
        if trails and b["low"][j] <= top * (1 - p.trail_pct):
            return j, top * (1 - p.trail_pct), "trailing_stop"
        if b["close"][j] >= target:
            return j, b["close"][j], "target_reached"
        safe = safe or profit >= p.breakeven_pct
    return len(b) - 1, b["close"][len(b) - 1], "end_of_backtest"


def test_first_exits_equal_a_loop(spark):
    b = walk(260, 5, sigma=0.02)
    rng, limit = random.Random(9), 0.03
    rows = []
    for i in range(5, 250, 3):
        price = float(b["close"][i - 1])
        rows.append(("000001", i, price, price * (1 - rng.uniform(0.02, 0.08)), price * (1 + rng.uniform(0.02, 0.15))))
    entries = spark.createDataFrame(rows, "symbol string, i long, entry double, stop double, target double")
    got = {r["i"]: (r["exit_i"], round(r["exit_raw"], 9), r["exit_reason"]) for r in trades.first_exits(entries, spark.createDataFrame(b), BASE, F.lit(limit)).collect()}
    for _, i, entry, stop, target in rows:
        j, price, why = first_exit_loop(b, i, entry, stop, target, BASE, limit)
        assert got[i] == (j, round(price, 9), why), i


def test_ledger_takes_one_position_at_a_time(spark):
    rows = [("s", 10, 15, 10.0, 11.0, 0.5), ("s", 12, 20, 10.0, 12.0, 0.5), ("s", 15, 18, 10.0, 9.0, 0.5), ("s", 30, 31, 1e6, 1e6, 0.5)]
    p = spark.createDataFrame(rows, "symbol string, i long, exit_i long, entry double, exit_raw double, position_pct double").withColumn("exit_reason", F.lit("x"))
    assert [r["i"] for r in trades.ledger(p).orderBy("i").collect()] == [10, 15]


def test_merges(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "symbol string, date int, close double")
    delta = spark.createDataFrame([("a", 1, 9.0), ("c", 1, 3.0)], "symbol string, date int, close double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(src.upsert(base, delta, ["symbol", "date"])) == [("a", 1, 9.0), ("b", 1, 2.0), ("c", 1, 3.0)]
    assert rows(src.insert_ignore(base, delta, ["symbol", "date"])) == [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0)]
    assert rows(src.upsert(base, base.limit(0), ["symbol", "date"])) == rows(base)


def test_registry_rules(spark):
    log = spark.createDataFrame([("x", 1, "shadow"), ("x", 2, "active"), ("x", 3, "shadow"), ("y", 1, "retired"), ("y", 2, "active")], "strategy_id string, at int, to_status string")
    assert sorted((r["strategy_id"], r["at"]) for r in registry.violations(log).collect()) == [("x", 3), ("y", 2)]


def test_calendar_goes_back_over_holidays(spark):
    days = spark.sql("select explode(sequence(date'2024-09-25', date'2024-10-08')) as day")
    got = {str(r["day"]): str(r["last_open"]) for r in quality.trading_days(days).collect()}
    assert got["2024-10-07"] == "2024-09-30" and got["2024-10-08"] == "2024-10-08"


def test_payloads(spark):
    body = 'quote_x({"data":"20240102,10.0,10.5,9.9,10.2,1000,10200;20240103,1,2,3,4;bad"});'
    got = src.parse_payloads(spark.createDataFrame([("s", body), ("t", None)], "symbol string, body string")).orderBy("date").collect()
    assert [(str(r["date"]), r["close"], r["volume"]) for r in got] == [("2024-01-02", 10.2, 1000.0), ("2024-01-03", 4.0, 0.0)]
