"""Entries in one pass over batches against frames and formulas of the operators."""

import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.functions.series import by_date, trailing
from tidebar.operators import detectors, strategy, trades
from tidebar.operators.strategy import BASE, STYLES

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def walk(n, seed, symbol, holes=0.0, sigma=0.012, drift=0.0008):
    rng, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        old, price = price, round(price * (1 + drift + rng.gauss(0, sigma)), 4)
        values = [old, round(max(old, price) * 1.008, 4), round(min(old, price) * 0.992, 4), price, float(rng.randint(10, 60) * 10_000)]
        rows.append((symbol, datetime.date(2020, 1, 3) + datetime.timedelta(days=k), *[None if rng.random() < holes else x for x in values]))
    return rows


def by_operators(bars, presets, limit):
    """Candidates from the operators, each frame a window of Spark."""
    known = strategy.REGIME + strategy.SCORE
    ctx = detectors.limit_flags(strategy.context(bars), limit, ("open", "high", "low", "close", "volume", *known))
    rows = strategy.price_frames(ctx, 30, ("high", "low", "limit_up", "limit_down", *known), tuple(sorted({p.target_lookback for p in presets})))
    prices = ("close", "n", "atr", "low5", "high60", "vr", "ret5", *sorted({f"prev_high_{p.target_lookback}" for p in presets}))
    grid = F.last(F.when(F.col("n") % trades.GRID == 0, F.struct(*known)), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
    at = rows.select("symbol", (F.col("n") - 1).alias("i"), "limit_up", F.lag(F.struct(*prices)).over(by_date()).alias("p"), grid.alias("g")).localCheckpoint()
    allowed = (F.col("i") >= trades.WARM_UP) & ~F.col("limit_up") & F.col("g").isNotNull()
    at = at.select("symbol", "i", allowed.alias("allowed"), "p.*", "g.*")
    found = []
    for k, p in enumerate(presets):
        s = strategy.with_signal(at.withColumn("prev_high", F.col(f"prev_high_{p.target_lookback}")), p).where("allowed and valid")
        found += [(k, *r) for r in s.select("symbol", "i", "entry", "stop", "target", "position_pct", "signal_type", "confidence").collect()]
    return sorted(found, key=str)


def by_batches(bars, presets, limit):
    rows = trades.candidate_rows(bars, presets, limit)
    return sorted(((k, *r) for k in range(len(presets)) for r in rows.where(f"c{k} is not null").select("symbol", "i", f"c{k}.*").collect()), key=str)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_entries_equal_the_operators(spark, small_batches):
    rows = walk(700, 1, "a") + walk(1, 2, "b") + walk(420, 3, "c", holes=0.03) + walk(1300, 4, "d", sigma=0.009) + walk(300, 5, None)
    bars = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), BAR)
    presets = [BASE, *STYLES]
    want = by_operators(bars, presets, F.lit(0.02))
    assert by_batches(bars, presets, F.lit(0.02)) == want
    assert {r[0] for r in want} == {0, 1, 2, 3} and {r[1] for r in want} >= {"a", "c", "d"}


def test_frames_are_no_windows(spark):
    bars = spark.createDataFrame(walk(20, 1, "a"), BAR)
    plan = trades.candidate_rows(bars, STYLES)._jdf.queryExecution().executedPlan().toString()
    assert sum(line.count("RowFrame, -") for line in plan.splitlines() if "Window [" in line) <= 4
    assert plan.count("Exchange hashpartitioning") == 1


def test_trailing_frames_equal_loops():
    rng = np.random.default_rng(3)
    n = np.concatenate([np.arange(1, size + 1) for size in (90, 1, 40, 200)])
    x = np.where(rng.random(len(n)) < 0.1, np.nan, np.round(rng.normal(10, 1, len(n)), 2))
    frames = {"m": ("mean", "x", -6, -2), "s": ("sum", "x", -3, 0), "hi": ("max", "x", -20, -1), "lo": ("min", "x", -4, 0), "sd": ("spread", "x", -9, 0), "l": ("lag", "x", -5, 0), "f": ("first", "x", -7, 0)}
    cuts = [0, 1, 50, 93, 95, 95, 300, len(n)]
    got = {name: [] for name in frames}
    for kept, _, out in trailing(["x"], frames)((pa.array(n[a:b]), pa.array(x[a:b], from_pandas=True)) for a, b in zip(cuts, cuts[1:])):
        for name, (v, null) in out.items():
            got[name] += [None if null is not None and null[k] else float(v[k]) for k in range(kept, len(v))]

    def value(name, t):
        kind, _, lo, hi = frames[name]
        if kind in ("lag", "first"):
            k = t - min(-lo, n[t] - 1) if kind == "first" else t + lo
            return None if n[t] + min(lo, 0) < 1 and kind == "lag" or math.isnan(x[k]) else float(x[k])
        v = [float(x[k]) for k in range(t + max(lo, 1 - int(n[t])), t + hi + 1) if not math.isnan(x[k])]
        total = 0.0
        for y in v:
            total += y
        return None if not v else {"mean": lambda: total / len(v), "sum": lambda: total, "max": lambda: max(v), "min": lambda: min(v), "spread": lambda: pytest.approx(float(np.std(v)), abs=1e-12)}[kind]()

    for name in frames:
        assert got[name] == [value(name, t) for t in range(len(n))], name


def test_exits_and_accounts_do_not_depend_on_batches(spark):
    bars = spark.createDataFrame(walk(700, 1, "a") + walk(900, 4, "d", sigma=0.02) + walk(333, 6, "e"), BAR)
    rows = trades.candidate_rows(bars, [BASE], F.lit(0.01))
    read = lambda: (sorted(map(tuple, trades.exits(rows).collect())), sorted(map(tuple, trades.account_trades(trades.accounts(rows, risk=trades.Risk())).collect())))
    whole = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = read()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == whole and len(whole[0]) > 20 and len(whole[1]) > 3


def test_closing_bars_hold_all_trades(spark):
    bars = spark.createDataFrame(walk(700, 1, "a") + walk(900, 4, "d", sigma=0.02), BAR)
    rows = trades.candidate_rows(bars, STYLES)
    every, closing = trades.accounts(rows, STYLES), trades.accounts(rows, STYLES, every=False)
    assert sorted(map(str, closing.collect())) == sorted(map(str, every.where(F.size("trades") > 0).collect()))
    assert every.count() == 3 * 1600 > 20 * closing.count() > 0


def test_rows_that_lost_their_order_are_an_error(spark):
    rows = trades.candidate_rows(spark.createDataFrame(walk(200, 1, "a"), BAR)).orderBy(F.desc("i"))
    for read in (trades.exits, trades.accounts):
        with pytest.raises(Exception, match="not in order"):
            read(rows).collect()


def test_a_symbol_without_a_name_has_an_account_too(spark):
    rows = walk(700, 1, "a") + walk(900, 4, "d", sigma=0.02)
    named = trades.accounts(trades.candidate_rows(spark.createDataFrame(rows, BAR)), risk=trades.Risk())
    null = trades.accounts(trades.candidate_rows(spark.createDataFrame([(None if r[0] == "a" else r[0], *r[1:]) for r in rows], BAR)), risk=trades.Risk())
    read = lambda states: sorted((r["symbol"] or "a", r["i"], r["cash"], str(r["h"]), str(r["trades"])) for r in states.collect())
    assert read(null) == read(named) and any(r[4] != "[]" for r in read(named) if r[0] == "a")
