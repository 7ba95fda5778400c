"""Hand-made series with the values that the formulas give by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidebar.operators import indicators, quality, registry
from tidebar.sources import bars as src


def bars_of(spark, closes):
    day = datetime.date(2024, 1, 1)
    rows = [("000001", day + datetime.timedelta(days=k), c, c * 1.01, c * 0.99, c, 1e6, c * 1e6) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")


def test_rsi_of_a_flat_series(spark):
    got = [r["rsi14"] for r in indicators.recursive_indicators(bars_of(spark, [100.0] * 5)).orderBy("date").collect()]
    assert got == [50.0, 0.0, 0.0, 0.0, 0.0]


def rsi_by_hand(closes, period=14):
    if len(closes) < period + 1:
        return 50.0
    tail = closes[-3 * period :]
    moves = [b - a for a, b in zip(tail, tail[1:])]
    gain, loss = (sum(max(s * m, 0.0) for m in moves[:period]) / period for s in (1, -1))
    for m in moves[period:]:
        gain, loss = (gain * (period - 1) + max(m, 0.0)) / period, (loss * (period - 1) + max(-m, 0.0)) / period
    return 100.0 if loss < 1e-10 else 100 - 100 / (1 + gain / loss)


def test_windowed_rsi_of_short_and_long_histories(spark):
    closes = [100.0 + (k * 7919) % 13 - 0.1 * k for k in range(60)]
    got = [r["rsi_window"] for r in indicators.rsi_windowed(bars_of(spark, closes)).orderBy("date").collect()]
    assert got == pytest.approx([rsi_by_hand(closes[: k + 1]) for k in range(60)], abs=1e-9)


def test_holidays_of_the_whole_year(spark):
    days = spark.sql("select explode(sequence(date'2026-09-28', date'2026-10-09')) as day")
    opened = [str(r["day"]) for r in quality.trading_days(days).where("open").orderBy("day").collect()]
    assert opened == ["2026-09-28", "2026-09-29", "2026-09-30", "2026-10-08", "2026-10-09"]


def test_ties_of_merges_are_defined(spark):
    base = bars_of(spark, [100.0])
    twice = base.withColumn("close", F.lit(5.0)).unionByName(base.withColumn("close", F.lit(4.0)))
    for order in (twice, twice.orderBy(F.desc("close")), twice.orderBy("close")):
        late = order.withColumn("date", F.date_add("date", 1))
        assert sorted(r["close"] for r in src.insert_ignore(base, late, ["symbol", "date"]).collect()) == [4.0, 100.0]
    seen = {src.upsert(base, d, ["symbol", "date"]).first()["close"] for d in (twice, twice.orderBy("close"), twice.orderBy(F.desc("close")))}
    assert len(seen) == 1 and seen <= {4.0, 5.0}


def test_files_and_validation(spark, tmp_path):
    b = bars_of(spark, [100.0, 101.0])
    src.write_bars(b, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 2
    src.save_results(b.select("symbol", "close"), b.select("symbol", "date"), b.agg(F.count("*").alias("n")), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "results")).count() == 2
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["n"] == 2
    (tmp_path / "codes.txt").write_text("000001\n\n 600519 \n")
    assert {r["symbol"] for r in src.read_symbol_list(spark, str(tmp_path / "codes.txt")).collect()} == {"000001", "600519"}
    (tmp_path / "600000.json").write_text('[{"date": "2024-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}]')
    assert tuple(src.read_bar_json(spark, str(tmp_path / "600000.json")).first())[:2] == ("600000", datetime.date(2024, 1, 2))
    with pytest.raises(ValueError):
        src.validate_bars(b.drop("high"))
    with pytest.raises(ValueError):
        src.validate_bars(b.limit(0))


def test_validation_results_move_strategies(spark):
    s = spark.createDataFrame([("a", "candidate", 0.0), ("b", "active", 1.0), ("c", "shadow", 2.0)], "strategy_id string, status string, validation_sharpe double")
    r = spark.createDataFrame([("a", True, 0.7), ("b", False, -1.0)], "strategy_id string, passed boolean, sharpe double")
    got = {x["strategy_id"]: (x["status"], x["validation_sharpe"]) for x in registry.apply_validation(s, r).collect()}
    assert got == {"a": ("active", 0.7), "b": ("retired", -1.0), "c": ("shadow", 2.0)}
    log = spark.createDataFrame([], "strategy_id string, at date, to_status string")
    assert {tuple(x)[::2] for x in registry.with_validation_log(log, s, r, F.to_date(F.lit("2024-01-01"))).collect()} == {("a", "active"), ("b", "retired")}
