"""Values that binary noise decides come out as in the SQL."""

import datetime as dt

from tidebar.operators import indicators
from tidebar.sources import bars as src


def series(spark, closes):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([("000001", day + dt.timedelta(i), c * 1.01, c * 0.99, c, 1e6) for i, c in enumerate(closes)], "symbol string, date date, high double, low double, close double, volume double")


def test_halves_of_prices_are_rounded_at_the_scaled_value(spark, tmp_path):
    """195.815 * 1.01 is just below 197.77315, though its shortest text is that half."""
    rows = [(n, 1, 1.0, 0.09, 0.04, dt.datetime(1998, 8, 7)) for n in range(42)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = src.bars_walk(spark, str(tmp_path)).first()
    assert (got["close"], got["high"]) == (195.815, 197.7731)


def test_macd_of_a_flat_beginning_follows_the_recursion(spark):
    closes = [191.9376] * 4 + [188.1247, 189.0, 189.0, 187.5, 188.0]
    e12 = e26 = closes[0]
    want, signal = [(e12, e26, 0.0)], 0.0
    for x in closes[1:8]:
        e12, e26 = 2 / 13 * x + (1 - 2 / 13) * e12, 2 / 27 * x + (1 - 2 / 27) * e26
        signal = 0.2 * (e12 - e26) + 0.8 * signal
        want.append((e12, e26, signal))
    got = indicators.recursive_indicators(series(spark, closes)).orderBy("date").collect()
    assert [(x["ema12"], x["ema26"], x["signal"]) for x in got[:8]] == want
