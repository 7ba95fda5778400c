"""Scans in segments, strict payloads, windows by arithmetic and the bootstrap, each against a plain computation."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import series
from tidebar.operators import indicators, validation
from tidebar.sources import bars as src


def long_bars(spark, n, symbols=1):
    """Bars of a few symbols with n bars each, dates as numbers."""
    b = spark.range(n * symbols).select(F.concat(F.lit("s"), F.col("id") % symbols).alias("symbol"), F.floor(F.col("id") / symbols).cast("int").alias("date"))
    c = b.withColumn("close", 100 + 20 * F.sin(F.col("date") / 37) + F.pmod(F.xxhash64("symbol", "date"), F.lit(1000)) / 100)
    return c.select("symbol", "date", (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close")


def test_exponential_means_equal_the_recursion(spark):
    b = long_bars(spark, 3000)
    got = series.with_ema(b, {"fast": (F.col("close"), 2 / 3, F.col("close")), "slow": (F.col("close"), 2 / 121, F.lit(0.0))}).orderBy("date").toPandas()
    fast, slow = got["close"][0], 0.0
    for k, x in enumerate(got["close"]):
        if k:
            fast, slow = fast + (x - fast) * 2 / 3, slow + (x - slow) * 2 / 121
        assert got["fast"][k] == pytest.approx(fast, rel=1e-12) and got["slow"][k] == pytest.approx(slow, rel=1e-11, abs=1e-12)


def test_segments_change_no_value(spark):
    b = long_bars(spark, 9000, 2).unionByName(long_bars(spark, 40).withColumn("symbol", F.lit("a#b")))
    whole = indicators.recursive_indicators(b).orderBy("symbol", "date").toPandas()
    parts = indicators.recursive_by_segments(b, F.floor(F.col("date") / 700), rows=2500).orderBy("symbol", "date").toPandas()
    assert list(whole["symbol"]) == list(parts["symbol"]) and list(whole["date"]) == list(parts["date"])
    for c in indicators.RECURSIVE:
        assert np.allclose(whole[c], parts[c], rtol=1e-10, atol=1e-10), c


def test_one_long_series_is_the_work_of_many_tasks(spark):
    b = long_bars(spark, 60_000)
    seen = series.by_segments(b, lambda d: d.withColumn("task", F.spark_partition_id()).withColumn("n", F.count("*").over(series.by_date())), 100, F.floor(F.col("date") / 5000), rows=5000)
    sizes = seen.groupBy("n").agg(F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in sizes) == 60_000 and max(r["n"] for r in sizes) <= 5100


def test_strict_payloads_name_their_reason(spark):
    lines = "20240102,1,2,0.5,1.5,100;20240103,1,2,0.5,1.5,100,7.5;;  ;20240104,1,2,0.5,1.5;20241304,1,2,0.5,1.5,100;20240105,1,x,0.5,1.5,100;20240106,1,2,0.5,1.5,1.5;20240107,1,2,0.5,1.5,1,z"
    df = spark.createDataFrame([("a", 'quote_x({"data":"' + lines + '"});'), ("b", "nothing"), ("c", None), ("d", 'q({"data":""});')], "symbol string, body string")
    got = src.parse_strict(df).collect()
    assert [(str(r["date"]), r["volume"], r["amount"]) for r in got if r["reason"] is None] == [("2024-01-02", 100.0, 0.0), ("2024-01-03", 100.0, 7.5)]
    assert [r["reason"] for r in got if r["symbol"] == "a" and r["reason"]] == ["fields", "date", "price", "volume", "amount"]
    assert [(r["symbol"], r["line"], r["reason"]) for r in got if r["reason"] == "body"] == [("b", "nothing", "body"), ("c", None, "body")]


def test_rows_meet_exactly_their_windows(spark):
    bars = spark.createDataFrame([("s", i) for i in range(700)] + [("t", i) for i in range(340)] + [("u", i) for i in range(100)], "symbol string, i long").withColumn("date", F.col("i"))
    windows = validation.walk_windows(bars, 200, 130, 50)
    got = {(r["symbol"], r["i"], r["part"], r["w"]) for r in validation.in_windows(bars.select("symbol", "i"), windows, 200, 130, 50).collect()}
    want = set()
    for w in windows.collect():
        want |= {(w["symbol"], i, "in", w["w"]) for i in range(w["train_from"], w["train_to"])} | {(w["symbol"], i, "out", w["w"]) for i in range(w["valid_from"], w["valid_to"])}
    assert got == want and want


def test_bootstrap_equals_explicit_weights(spark):
    rng = random.Random(4)
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), rng.gauss(0.001, 0.02)) for s in ("a", "b") for k in range(90)] + [("a", datetime.date(2025, 1, 1), None)]
    got = {r["symbol"]: r for r in validation.bootstrap(spark.createDataFrame(rows, "symbol string, date date, r double").repartition(3), 300).collect()}
    for s in ("a", "b"):
        means, weights = [], []
        for k in range(1, 301):
            total = weight = 0
            for name, d, r in rows:
                if name == s and r is not None:
                    h = hashlib.md5(f"{name}|{d}|42".encode()).hexdigest()
                    u = (int(h[:7], 16) * ((k * 48271 + 11) % validation.PRIME) + int(h[7:14], 16)) % validation.PRIME
                    w = sum(u >= c for c in validation.POISSON_CUTS)
                    total, weight = total + r * w, weight + w
                    weights.append(w)
            means.append(total / weight)
        assert got[s]["ci_lo"] == pytest.approx(np.percentile(means, 5) * 25200, abs=0.006) and got[s]["ci_hi"] == pytest.approx(np.percentile(means, 95) * 25200, abs=0.006)
        assert got[s]["pos_rate"] == pytest.approx(np.mean(np.array(means) > 0), abs=6e-4)
        assert abs(np.mean(weights) - 1) < 0.02 and abs(np.var(weights) - 1) < 0.05


def test_slices_of_windows_equal_loops_and_copy_no_points(spark):
    rng = random.Random(8)
    rows = [(s, i, round(100_000 * (1 + 0.05 * rng.random()), 2) if (s, i) != ("s", 300) and not (s == "t" and 200 <= i < 330) else None if s == "s" else 100_000.0) for s, n in (("s", 700), ("t", 460), ("u", 131), (None, 340)) for i in range(130, n)]
    curve = spark.createDataFrame(rng.sample(rows, len(rows)), "symbol string, i long, total double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    try:
        slices = validation.slice_metrics(curve)
        got = {(r["symbol"], r["w"], r["part"]): (r["ret"], r["mu"], r["sd"]) for r in slices.collect()}
        assert "Generate" not in slices._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in ("s", "t", "u", None):
        own = {i: x for name, i, x in rows if name == s}
        for w in range(14):
            for part, lo, hi in (("in", w * 50, w * 50 + 200), ("out", w * 50 + 200, w * 50 + 330)):
                at = [own[i] for i in range(lo, hi) if i in own]
                if at:
                    r = [b / a - 1 for a, b in zip(at, at[1:]) if a and b]
                    ret = at[-1] / at[0] - 1 if at[0] and at[-1] else None
                    want[s, w, part] = (ret, np.mean(r) if r else None, np.std(r, ddof=1) if len(r) > 1 else None)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == tuple(x if x is None else pytest.approx(float(x), abs=1e-12) for x in values), key
    assert got["t", 0, "out"][2] == 0.0
