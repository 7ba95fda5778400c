"""Entry-signal detectors at every bar: (symbol, date, signal, strength) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import row_no, frame, lag, max_rows, mean_rows, min_rows, settled, strict

SHORT, SWING, MEDIUM = "short_term", "swing", "medium_term"


def board_limit(symbol: str | Column = "symbol") -> Column:
    """Daily limit of the symbol's board."""
    return F.when(F.substring(symbol, 1, 3).isin("688", "300", "301"), 0.195).otherwise(0.095)


def flags(limit: Column | None = None, prev: Column | None = None) -> list[Column]:
    """Whether a bar closed at its upper and at its lower limit."""
    limit = board_limit() if limit is None else limit
    ret = F.col("close") / (lag("close") if prev is None else prev) - 1
    return [F.coalesce(ret >= limit, F.lit(False)).alias("limit_up"), F.coalesce(ret <= -limit, F.lit(False)).alias("limit_down")]


def limit_flags(bars: DataFrame, limit: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return bars.select("symbol", "date", *keep, *flags(limit))


def ratio(a: Column, b: Column) -> Column:
    return a / (b + 1e-8)


def frames(bars: DataFrame) -> DataFrame:
    """Every trailing value the detectors read, in one pass over one sort."""
    c, v = F.col("close"), F.col("volume")
    sd = strict(F.stddev_samp("close").over(frame(-19)), 20)
    b = bars.select(
        "symbol", "date", "open", "high", "low", "close", "volume", row_no().alias("rn"), (c / lag("close") - 1).alias("ret1"), lag("close").alias("c1"), lag("high").alias("h1"), lag("low").alias("l1"),
        (lag("close") / lag("close", 2) - 1).alias("yret"), (c / lag("close", 5) - 1).alias("ret5"),
        ratio(v, mean_rows("volume", -4, -2)).alias("vr_limit"), ratio(v, mean_rows("volume", -5, -1)).alias("vr5"),
        ratio(mean_rows("volume", -2), mean_rows("volume", -7, -3)).alias("vr_cross"), ratio(mean_rows("volume", -2), mean_rows("volume", -19, -3)).alias("vr_platform"),
        ratio(mean_rows("volume", -2), mean_rows("volume", -9, -3)).alias("vr_pull"), ratio(mean_rows("volume", -4), mean_rows("volume", -9, -5)).alias("vr_div"),
        mean_rows("volume", -19, -1).alias("v19"), mean_rows("close", -4).alias("m5"), mean_rows("close", -5, -1).alias("m5p"),
        mean_rows("close", -19).alias("m20"), mean_rows("close", -20, -1).alias("m20p"), mean_rows("close", -59).alias("m60"), mean_rows("close", -60, -1).alias("m60p"),
        max_rows("high", -20, -1).alias("hi20"), min_rows("close", -20, -1).alias("lo20"), max_rows("close", -9, -1).alias("top9"), max_rows("high", -60, -1).alias("hi60"), sd.alias("sd"))
    b = b.withColumn("up", F.col("m20") + 2 * F.col("sd")).withColumn("lo", F.col("m20") - 2 * F.col("sd"))
    return b.withColumn("up1", lag("up")).withColumn("lo1", lag("lo"))


def cap(x: Column, top: float) -> Column:
    return settled(F.least(x, F.lit(top)), 3)


def rules(limit: Column) -> list[tuple[str, str, Column, Column]]:
    """(style, signal, condition, strength) of each detector over ``frames``."""
    f = F.col
    gap = (f("open") - f("h1")) / (f("h1") + 1e-8)
    spot = (f("close") - f("low")) / (f("high") - f("low") + 1e-8)
    width = (f("hi20") - f("lo20")) / (f("lo20") + 1e-8)
    away = F.abs(f("close") - f("m20")) / (f("m20") + 1e-8)
    above = (f("close") > f("up")) & (f("c1") <= f("up1")) & (f("vr5") >= 1.3)
    below = (f("c1") <= f("lo1")) & (f("close") > f("lo"))
    return [
        (SHORT, "limit_up_follow", (f("yret") >= limit * 0.95) & (f("ret1") >= 0.005) & (f("vr_limit") >= 1), cap(0.60 + f("yret") * 2 + (f("vr_limit") - 1.15) * 0.1, 0.95)),
        (SHORT, "gap_up_breakout", (gap >= 0.02) & (f("vr5") >= 1.5) & (f("close") >= f("open") * 0.98), cap(0.50 + gap * 5 + (f("vr5") - 1.5) * 0.05, 0.90)),
        (SHORT, "ma_golden_cross", (f("rn") >= 25) & (f("m5p") <= f("m20p")) & (f("m5") > f("m20")) & (f("vr_cross") >= 0.9) & (f("close") >= f("m20") * 0.99), cap(0.60 + (f("vr_cross") - 1) * 0.15, 0.85)),
        (SHORT, "intraday_surge", (f("ret1") >= 0.03) & (f("vr5") >= 1.5) & (spot >= 0.5), cap(0.50 + f("ret1") * 5 + (f("vr5") - 1.5) * 0.05, 0.85)),
        (SWING, "swing_breakout", (f("rn") >= 25) & (width <= 0.08 * 1.5) & (f("close") > f("hi20") * 1.005) & (f("vr_platform") >= 1.5),
         cap(0.55 + (f("close") - f("hi20")) / (f("hi20") + 1e-8) * 10 + (f("vr_platform") - 1.5) * 0.08, 0.92)),
        (SWING, "pullback_ma", (f("rn") >= 25) & (away <= 0.02) & (f("top9") >= f("m20") * 1.05) & (f("vr_pull") <= 0.8) & (f("low") >= f("l1")),
         cap(0.55 + (0.02 - away) * 10 + (0.8 - f("vr_pull")) * 0.2, 0.82)),
        (SWING, "volume_divergence", (f("ret5") < 0) & (f("ret5") >= -0.05) & (f("vr_div") < 0.65) & (f("m5") >= f("m20") * 0.99), cap(0.50 + F.abs(f("ret5")) * 3 + (0.65 - f("vr_div")) * 0.5, 0.78)),
        (SWING, "bollinger_breakout", above | below,
         F.when(above, cap(0.60 + (f("close") / f("up") - 1) * 10 + (f("vr5") - 1.3) * 0.05, 0.88)).otherwise(cap(0.52 + (f("close") / f("lo") - 1) * 5, 0.72))),
        (MEDIUM, "swing_breakout", (f("rn") >= 65) & (f("close") > f("hi60")) & (f("volume") > f("v19") * 1.5), F.lit(0.80)),
        (MEDIUM, "ma_golden_cross", (f("rn") >= 65) & (f("m20p") <= f("m60p")) & (f("m20") > f("m60")), F.lit(0.75)),
    ]


def detect_all(bars: DataFrame, limit: Column | None = None, min_rows_: int = 30) -> DataFrame:
    """All signals of all bars: ``symbol, date, style, signal, strength``."""
    found = [F.when(test, F.struct(F.lit(style).alias("style"), F.lit(name).alias("signal"), strength.alias("strength"))) for style, name, test, strength in rules(board_limit() if limit is None else limit)]
    return frames(bars).where(F.col("rn") >= min_rows_).select("symbol", "date", F.inline(F.array_compact(F.array(*found))))


def best_signal(signals: DataFrame, styles: tuple[str, ...] = (SHORT, SWING), least: float = 0.5) -> DataFrame:
    """Strongest signal of each bar, ties by name."""
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("strength"), "signal")
    return signals.where(F.col("style").isin(*styles) & (F.col("strength") >= least)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
