"""Technical indicators at every bar, their signals and price adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import by_date, by_segments, ema_memory, row_no, change, frame, lag, max_rows, mean_rows, min_rows, settled, strict, with_ema

DAYS = 252


def true_range(prev: Column | None = None) -> Column:
    prev = lag("close") if prev is None else prev
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def moving_averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60, 120)) -> DataFrame:
    return bars.select("symbol", "date", *[mean_rows("close", 1 - p).alias(f"ma{p}") for p in periods])


def partial_averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Means of up to p rows."""
    return bars.select("symbol", "date", *[F.avg("close").over(frame(1 - p)).alias(f"MA{p}") for p in periods])


def returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "close", lag("close").alias("prev_close"), change("close").alias("ret"))


def volatility(bars: DataFrame, window: int = 20) -> DataFrame:
    r = bars.select("symbol", "date", change("close").alias("ret"))
    w = frame(1 - window)
    return r.select("symbol", "date", F.when(F.count("ret").over(w) >= 2, F.stddev_samp("ret").over(w) * (DAYS**0.5)).alias("volatility"))


def rsi_simple(bars: DataFrame, window: int = 14) -> DataFrame:
    d = bars.select("symbol", "date", F.coalesce(F.col("close") - lag("close"), F.lit(0.0)).alias("d"))
    gain, loss = mean_rows(F.greatest("d", F.lit(0.0)), 1 - window), mean_rows(F.greatest(-F.col("d"), F.lit(0.0)), 1 - window)
    return d.select("symbol", "date", (100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))).alias("rsi_simple"))


def bollinger(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    sd = strict(F.stddev_samp("close").over(frame(1 - period)), period)
    b = bars.select("symbol", "date", "close", mean_rows("close", 1 - period).alias("mid"), sd.alias("sd"))
    up, lo = F.col("mid") + k * F.col("sd"), F.col("mid") - k * F.col("sd")
    return b.select("symbol", "date", "close", "mid", up.alias("upper"), lo.alias("lower"), ((up - lo) / (F.col("mid") + 1e-10)).alias("width"), ((F.col("close") - lo) / (up - lo + 1e-10)).alias("pct_b"))


def atr_sma(bars: DataFrame, window: int = 14) -> DataFrame:
    return bars.select("symbol", "date", true_range().alias("tr")).select("symbol", "date", "tr", F.avg("tr").over(frame(1 - window)).alias("atr_sma"))


def rsv() -> Column:
    low, high = min_rows("low", -8), max_rows("high", -8)
    return F.coalesce(100 * (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(50.0))


RSI_BLOCK = 64


def with_rsi_window(df: DataFrame, name: str = "rsi_window", period: int = 14) -> DataFrame:
    """Adds the RSI of the last ``3 * period`` closes: a simple mean of ``period`` differences seeds Wilder's recursion over the rest.

    ``df`` has the differences ``d``. The recursion is a weighted sum with weights q**age. Within a block of ``RSI_BLOCK`` rows a weight is q**(own place)
    over q**(place of the row), so the sum over a frame is a plain frame sum of rescaled rows; a frame touches two blocks at most, one of even and one of odd number.
    Shorter histories use the differences they have; with under ``period`` of them it is 50.
    """
    rest, q = 2 * period - 1, (period - 1) / period
    block = max(RSI_BLOCK, rest)
    had = F.col("__n") - 1  # differences; the first row has none
    b = df.withColumn("__n", row_no()).withColumn("__odd", F.floor(F.col("__n") / block) % 2 == 1).withColumn("__at", F.pow(F.lit(q), F.col("__n") % block))
    up, down = F.greatest("d", F.lit(0.0)), F.greatest(-F.col("d"), F.lit(0.0))
    first, recent = by_date().rowsBetween(-(rest + period - 1), -rest), by_date().rowsBetween(1 - rest, 0)
    start = by_date().rowsBetween(-(rest + period - 1), 0)
    full = had >= rest + period

    def smoothed(x: Column) -> Column:
        own = F.when(had > period, x / F.col("__at")).otherwise(0.0)
        even, odd = F.sum(F.when(~F.col("__odd"), own).otherwise(0.0)).over(recent), F.sum(F.when(F.col("__odd"), own).otherwise(0.0)).over(recent)
        same, before = F.when(F.col("__odd"), odd).otherwise(even), F.when(F.col("__odd"), even).otherwise(odd)
        seed = F.when(full, F.sum(x).over(first) * q**rest).otherwise(F.sum(F.when(had <= period, x).otherwise(0.0)).over(start) * F.pow(F.lit(q), had - period))
        return (seed + F.col("__at") * (same + before * q**block)) / period

    b = b.withColumns({"__gain": smoothed(up), "__loss": smoothed(down)})
    rsi = F.when(had < period, 50.0).when(F.col("__loss") < 1e-10, 100.0).otherwise(100 - 100 / (1 + F.col("__gain") / F.col("__loss")))
    return b.withColumn(name, rsi).drop("__n", "__odd", "__at", "__gain", "__loss")


def rsi_windowed(bars: DataFrame) -> DataFrame:
    d = bars.select("symbol", "date", F.coalesce(F.col("close") - lag("close"), F.lit(0.0)).alias("d"))
    return with_rsi_window(d).select("symbol", "date", "rsi_window")


def exponential_averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Exponential means with weight 2 / (p + 1), from the first close on."""
    c = F.col("close")
    return with_ema(bars, {f"ema{p}": (c, 2 / (p + 1), c) for p in periods}).select("symbol", "date", *[f"ema{p}" for p in periods])


#: Weight of a new difference in Wilder's means.
WILDER = 1 / 14


def with_wilder_rsi(df: DataFrame, name: str = "rsi14") -> DataFrame:
    """Adds the RSI of the whole history by Wilder's recursion, 50 at the first bar."""
    d, zero = F.coalesce(F.col("close") - lag("close"), F.lit(0.0)), F.lit(0.0)
    out = with_ema(df.withColumn("__d", d), {"__gain": (F.greatest("__d", zero), WILDER, zero), "__loss": (F.greatest(-F.col("__d"), zero), WILDER, zero)})
    return out.withColumn(name, F.when(row_no() == 1, 50.0).otherwise(100 - 100 / (1 + F.col("__gain") / (F.col("__loss") + 1e-10)))).drop("__d", "__gain", "__loss")


#: The longest mean here has the weight 1 / 14; nine rows more are those of the stochastic range.
RECURSIVE_MEMORY = ema_memory(1 / 14) + ema_memory(1 / 5) + 10


#: First rows in which the MACD is computed step by step.
START = 8


def macd_start() -> Column:
    """EMA(12), EMA(26) and signal line by their recursions over the closes ``__first`` from a symbol's first bar on.

    While no close has differed from the first one, MACD and signal are 0 but for the noise of these very steps, and crossings are read off it.
    """
    a, b = 2 / 13, 2 / 27
    state = lambda e12, e26, signal: F.struct(e12.alias("ema12"), e26.alias("ema26"), signal.alias("signal"))

    def step(s: Column, x: Column) -> Column:
        e12, e26 = a * x + (1 - a) * s["ema12"], b * x + (1 - b) * s["ema26"]
        return state(e12, e26, 0.2 * (e12 - e26) + 0.8 * s["signal"])

    first = F.col("__first")[0]
    return F.when(F.size("__first") > 0, F.aggregate(F.slice("__first", 2, START), state(first, first, F.lit(0.0)), step))


def with_recursive(df: DataFrame) -> DataFrame:
    """Adds EMA, MACD, Wilder RSI, KDJ and ATR to bars. All are exponential means, so they are scans over the symbol's one sort."""
    c, zero = F.col("close"), F.lit(0.0)
    b = df.withColumn("__begun", F.when(row_no() <= START, c)).withColumn("__first", F.collect_list("__begun").over(frame(1 - START)))
    b = b.withColumn("__start", F.when(F.col("__begun").isNotNull(), macd_start())).drop("__begun", "__first")
    b = with_wilder_rsi(b.withColumns({"__tr": true_range(), "__rsv": rsv()}))
    b = with_ema(b, {"ema12": (c, 2 / 13, c), "ema26": (c, 2 / 27, c), "k": (F.col("__rsv"), 1 / 3, F.col("__rsv")), "atr14": (F.col("__tr"), 2 / 15, F.col("__tr"))})
    begun = lambda name: F.coalesce(F.col("__start")[name], F.col(name))
    b = b.withColumns({name: begun(name) for name in ("ema12", "ema26")}).withColumn("macd", F.col("ema12") - F.col("ema26"))
    b = with_ema(b, {"signal": (F.col("macd"), 0.2, zero), "d": (F.col("k"), 1 / 3, F.col("k"))})
    b = b.withColumn("signal", begun("signal"))
    return b.withColumns({"hist": F.col("macd") - F.col("signal"), "j": 3 * F.col("k") - 2 * F.col("d")}).drop("__tr", "__rsv", "__start")


RECURSIVE = ["ema12", "ema26", "macd", "signal", "hist", "rsi14", "k", "d", "j", "atr14"]


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """EMA, MACD, Wilder RSI, KDJ and ATR of each bar."""
    return with_recursive(bars).select("symbol", "date", *RECURSIVE)


def recursive_by_segments(bars: DataFrame, bucket: Column, rows: int = 65_536) -> DataFrame:
    """The same with every symbol's series cut into segments, for series too long for one task."""
    return by_segments(bars.select("symbol", "date", "high", "low", "close"), recursive_indicators, RECURSIVE_MEMORY, bucket, rows)


def calculate_all(bars: DataFrame) -> DataFrame:
    """All indicators in one wide row per bar."""
    averages = [f"ma{p}" for p in (5, 20, 60, 120)]
    wide = bars.select(
        "symbol", "date", "high", "low", "close", *[mean_rows("close", 1 - p).alias(f"ma{p}") for p in (5, 20, 60, 120)], mean_rows("volume", -19).alias("vol_ma20"),
        strict(F.stddev_samp("close").over(frame(-19)), 20).alias("sd"))
    wide = wide.withColumn("bb_upper", F.col("ma20") + 2 * F.col("sd")).withColumn("bb_lower", F.col("ma20") - 2 * F.col("sd"))
    return with_recursive(wide).select("symbol", "date", "close", *averages, "vol_ma20", "bb_upper", "bb_lower", *RECURSIVE)


def calculate_all_batch(bars: DataFrame) -> DataFrame:
    """The batch flavour of the wide row: partial means, returns, volatility, simple RSI, bands and simple ATR beside the recursive series."""
    b = bars.select(
        "symbol", "date", "close", *[F.avg("close").over(frame(1 - p)).alias(f"MA{p}") for p in (5, 10, 20, 60)], change("close").alias("ret"), true_range().alias("tr"),
        F.coalesce(F.col("close") - lag("close"), F.lit(0.0)).alias("diff"), mean_rows("close", -19).alias("mid"), strict(F.stddev_samp("close").over(frame(-19)), 20).alias("sd"))
    gain, loss = mean_rows(F.greatest("diff", F.lit(0.0)), -13), mean_rows(F.greatest(-F.col("diff"), F.lit(0.0)), -13)
    wide = b.select(
        "symbol", "date", "close", "MA5", "MA10", "MA20", "MA60", "ret", F.when(F.count("ret").over(frame(-19)) >= 2, F.stddev_samp("ret").over(frame(-19)) * (DAYS**0.5)).alias("volatility"),
        (100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))).alias("rsi_simple"), (F.col("mid") + 2 * F.col("sd")).alias("upper"), (F.col("mid") - 2 * F.col("sd")).alias("lower"),
        F.avg("tr").over(frame(-13)).alias("atr_sma"))
    return wide.join(recursive_indicators(bars), ["symbol", "date"])


def crossing(a: str, b: str) -> tuple[Column, Column]:
    """(a crosses above b, a crosses below b)."""
    pa, pb = lag(a), lag(b)
    return (pa <= pb) & (F.col(a) > F.col(b)), (pa >= pb) & (F.col(a) < F.col(b))


def first_rule(*rules: tuple[Column, str]) -> Column:
    out = F.when(row_no() == 1, "neutral")
    for test, name in rules:
        out = out.when(test, name)
    return out.otherwise("neutral")


def signals(wide: DataFrame) -> DataFrame:
    """Buy, sell or neutral of MACD, RSI, KDJ and Bollinger bands at every bar, and their weighted combination."""
    up, down = crossing("macd", "signal")
    h0, r0, c0 = lag("hist"), lag("rsi14"), lag("close")
    kup, kdown = crossing("k", "d")
    s = wide.select(
        "symbol", "date",
        first_rule((up, "buy"), (down, "sell"), ((h0 <= 0) & (F.col("hist") > 0), "buy"), ((h0 >= 0) & (F.col("hist") < 0), "sell")).alias("macd"),
        first_rule(((r0 <= 30) & (F.col("rsi14") > 30), "buy"), ((r0 >= 70) & (F.col("rsi14") < 70), "sell"), (F.col("rsi14") > 70, "sell"), (F.col("rsi14") < 30, "buy")).alias("rsi14"),
        first_rule((kup & (F.col("j") < 80), "buy"), (kdown & (F.col("j") > 20), "sell"), (F.col("j") < 0, "buy"), (F.col("j") > 100, "sell")).alias("kdj"),
        first_rule(
            ((c0 <= lag("bb_lower")) & (F.col("close") > c0), "buy"), ((c0 >= lag("bb_upper")) & (F.col("close") < c0), "sell"),
            (F.col("close") > F.col("bb_upper"), "sell"), (F.col("close") < F.col("bb_lower"), "buy")).alias("boll"))
    return s.withColumn("combined", combined()).withColumn("decision", F.when(F.col("combined") > 0.3, "buy").when(F.col("combined") < -0.3, "sell").otherwise("neutral"))


WEIGHTS = {"macd": 0.3, "rsi14": 0.25, "kdj": 0.25, "boll": 0.2}


def combined() -> Column:
    """Weighted vote; neutral votes are left out of the denominator."""
    sign = lambda c: F.when(F.col(c) == "buy", 1.0).when(F.col(c) == "sell", -1.0).otherwise(0.0)
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in WEIGHTS.items():
        total, weight = total + w * sign(c), weight + w * F.abs(sign(c))
    return F.round(F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0)), 4)


def tall(wide: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, date, indicator_name, value) rows; nulls are left out."""
    return wide.unpivot(["symbol", "date"], names, "indicator_name", "value").where("value is not null")


#: The value that each signal is read from.
SIGNAL_VALUES = {"macd": "hist", "rsi14": "rsi14", "kdj": "j", "boll": "close"}


def indicator_records(wide: DataFrame) -> DataFrame:
    """(symbol, name, value, timestamp, signal) of each indicator at each bar of ``calculate_all``."""
    said = signals(wide).select("symbol", "date", *[F.col(n).alias(f"{n}_signal") for n in SIGNAL_VALUES])
    both = wide.select("symbol", "date", *dict.fromkeys(SIGNAL_VALUES.values())).join(said, ["symbol", "date"])
    records = [F.struct(F.lit(n).alias("name"), F.col(v).alias("value"), F.date_format("date", "yyyy-MM-dd").alias("timestamp"), F.col(f"{n}_signal").alias("signal")) for n, v in SIGNAL_VALUES.items()]
    return both.select("symbol", F.inline(F.array(*records)))


def adjust_prices(bars: DataFrame, mode: str = "backward", low: float = 0.88, high: float = 1.12) -> DataFrame:
    """Prices adjusted for ex-days, which are opens outside (low, high) times the close before."""
    prev = lag("close")
    ratio = F.when(prev > 0, F.col("open") / prev)
    b = bars.withColumn("f", F.when((ratio < low) | (ratio > high), ratio).otherwise(1.0))
    if mode == "backward":
        factor = F.exp(F.coalesce(F.sum(F.log("f")).over(by_date().rowsBetween(1, 2**31 - 1)), F.lit(0.0)))
    else:
        factor = F.exp(-F.sum(F.log("f")).over(by_date().rowsBetween(-(2**31) + 1, 0)))
    b = b.withColumn("adjust", factor)
    return b.select("symbol", "date", *[settled(F.col(c) * F.col("adjust"), 4).alias(c) for c in ("open", "high", "low", "close")], "volume", "adjust")
