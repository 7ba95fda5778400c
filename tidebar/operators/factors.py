"""Six-factor score of every symbol at every bar, with hard filters, grades and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import row_no, clamp, frame, lag, rounded_at, scaled, settled, with_means
from .indicators import with_rsi_window

MIN_ROWS, MIN_VOLUME, BELOW_COST, OVERSOLD = 125, 1e5, 0.12, 20.0
WEIGHTS = {"momentum": 35.0, "turnover": 20.0, "trend": 20.0, "rsi": 10.0, "vol_price": 10.0, "cost": 5.0}


#: Strict means that the factors read.
MEANS = {
    "m5": ("close", -4, 0), "m20": ("close", -19, 0), "m60": ("close", -59, 0), "ma120": ("close", -119, 0), "v5": ("volume", -4, 0), "v5_before": ("volume", -9, -5), "v10": ("volume", -9, 0),
    "v10_before": ("volume", -19, -10), "v20": ("volume", -19, 0),
}


def past_return(n: int) -> Column:
    return F.coalesce(F.col("close") / F.col(f"c{n}") - 1, F.lit(0.0))


def volume_ratio() -> Column:
    return F.col("v10") / (F.col("v10_before") + 1e-8)


def momentum() -> Column:
    support = F.when(F.col("rn") >= 20, clamp(0.5 + (volume_ratio() - 1) * 0.5)).otherwise(0.5)
    base = 0.25 * scaled(past_return(5), -0.08, 0.08) + 0.45 * scaled(past_return(20), -0.15, 0.15) + 0.30 * scaled(past_return(60), -0.30, 0.30)
    return clamp(base + F.when(support > 0.6, 0.05).when(support < 0.4, -0.05).otherwise(0.0))


def turnover() -> Column:
    ratio = volume_ratio()
    level = (
        F.when((ratio >= 1.2) & (ratio <= 2.5), F.least(F.lit(1.0), 0.5 + (ratio - 1.2) / 2.6))
        .when(ratio > 2.5, F.greatest(F.lit(0.3), 1 - (ratio - 2.5) * 0.15)).otherwise(F.greatest(F.lit(0.0), ratio / 1.2 * 0.5))
    )
    rising = F.col("v5") > F.col("v5_before") * 1.05
    return F.when(F.col("rn") >= 20, F.when(rising, F.least(F.lit(1.0), level + 0.1)).otherwise(level)).otherwise(0.5)


def trend() -> Column:
    c, m5, m20, m60 = F.col("close"), F.col("m5"), F.col("m20"), F.col("m60")
    base = (
        0.25 * (c > m5).cast("int") + 0.25 * (m5 > m20).cast("int") + 0.20 * (m20 > m60).cast("int") + 0.15 * (c > m20).cast("int") + 0.15 * (c > m60).cast("int")
    )
    away = (c - m20) / (m20 + 1e-8)
    return F.when(F.col("rn") >= 120, F.when((away >= 0.02) & (away <= 0.08), F.least(F.lit(1.0), base + 0.05)).otherwise(base)).otherwise(0.5)


def rsi_band(x: Column) -> Column:
    return (
        F.when((x >= 50) & (x <= 65), 1.0).when((x >= 45) & (x < 50), 0.85).when((x > 65) & (x <= 72), 0.75)
        .when((x >= 40) & (x < 45), 0.60).when((x > 72) & (x <= 80), 0.50).when(x > 80, 0.20).otherwise(0.35)
    )


def vol_price() -> Column:
    return F.when(F.col("rn") >= 11, clamp(0.5 + 0.5 * F.col("with_volume") / 10)).otherwise(0.5)


def cost() -> Column:
    m = F.col("ma120")
    x = (F.col("close") - m) / (m + 1e-8)
    band = (
        F.when((x >= 0.05) & (x <= 0.20), 1.0).when((x > 0.20) & (x <= 0.35), 0.70).when(x > 0.35, 0.30)
        .when((x >= 0) & (x < 0.05), 0.85).when((x >= -0.05) & (x < 0), 0.60).otherwise(0.20)
    )
    return F.when(F.col("rn") >= 120, band).otherwise(0.5)


#: Frames that the regime reads too, by their names here and there.
SHARED = {"m20": "m20", "m60": "m60", "ma120": "m120", "v10": "v_now", "v10_before": "v_before", "c5": "c5", "c20": "c20", "c60": "c60"}


def parts(bars: DataFrame, keep: tuple[str, ...] = (), series: str | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """The six factors (0 to 1), the RSI they use and the first failed filter of every bar. RSI is the windowed one, or the column ``series``.

    Each frame is a column of its own that the formulas read; those in ``known`` are in the struct ``frames`` of ``bars`` already.
    """
    dc, dv = F.col("close") - lag("close"), F.col("volume") - lag("volume")
    b = bars.select(
        "symbol", "date", "close", "volume", F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), *([F.col(series).alias("rsi_w")] if series else []), *[F.col("frames")[k].alias(k) for k in known], row_no().alias("rn"),
        F.coalesce(dc, F.lit(0.0)).alias("d"), dv.alias("dv"))
    b = b if series else with_rsi_window(b, "rsi_w")
    # Days that rise on rising volume less those that fall on it.
    signed = F.when(F.col("dv") > 0, F.signum("d")).otherwise(0.0)
    b = with_means(b.withColumn("signed", signed), {k: v for k, v in MEANS.items() if k not in known})
    b = b.withColumns({**{f"c{n}": lag("close", n) for n in (5, 20, 60) if f"c{n}" not in known}, "with_volume": F.sum("signed").over(frame(-9))})
    vol20 = F.when(F.col("rn") >= 20, F.col("v20")).otherwise(F.col("volume"))
    b = b.select(
        "symbol", "date", "close", "volume", *[F.col("kept")[k].alias(k) for k in keep], "rn", "rsi_w", vol20.alias("vol20"), "ma120", momentum().alias("momentum"), turnover().alias("turnover"), trend().alias("trend"),
        vol_price().alias("vol_price"), cost().alias("cost"))
    fail = (
        F.when(F.col("rn") < MIN_ROWS, "short_history").when(F.col("vol20") < MIN_VOLUME, "low_volume")
        .when(F.col("close") < F.col("ma120") * (1 - BELOW_COST), "below_cost").when(F.col("rsi_w") < OVERSOLD, "oversold")
    )
    return b.withColumn("rsi", rsi_band(F.col("rsi_w"))).withColumn("reason", fail)


def score(bars: DataFrame, keep: tuple[str, ...] = (), series: str | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """``total_score`` 0 to 100, grade and sub-scores; failed filters score 0. The options are those of ``parts``."""
    p = parts(bars, keep, series, known)
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    passed = F.col("reason").isNull()
    out = p.withColumn("passed", passed).withColumn("total_score", F.when(passed, rounded_at(total, 2)).otherwise(0.0))
    return out.withColumn("grade", grade("total_score"))


#: The labels of the report.
REPORT = {"momentum": "动量", "turnover": "换手", "trend": "趋势", "rsi": "RSI", "vol_price": "量价", "cost": "成本"}


def report_lines(scores: DataFrame) -> DataFrame:
    """(symbol, date, line): each score as one line of text, or why it was filtered out; halves of the total go up, those of a part to the even number."""
    parts = [F.format_string(f"{label}:%.0f", F.bround(F.round(F.col(c) * 100, 1), 0)) for c, label in REPORT.items()]
    passed = F.concat(F.format_string("  %s [%s] 总分=%.1f | ", "symbol", "grade", settled(F.col("total_score"), 1)), F.concat_ws("  ", *parts))
    return scores.select("symbol", "date", F.when(F.col("passed"), passed).otherwise(F.format_string("  %s: ❌ 过滤 (%s)", "symbol", "reason")).alias("line"))


def grade(c: str) -> Column:
    x = F.col(c)
    return F.when(x >= 75, "A").when(x >= 60, "B").when(x >= 45, "C").otherwise("D")


def ranked(scores: DataFrame, min_score: float = 45.0) -> DataFrame:
    """Rank of each passing symbol at each date, best first, ties by symbol."""
    w = Window.partitionBy("date").orderBy(F.desc("total_score"), "symbol")
    return scores.where(F.col("passed") & (F.col("total_score") >= min_score)).withColumn("rank", F.row_number().over(w))


def select_top(scores: DataFrame, n: int = 5, min_grade: str = "B") -> DataFrame:
    return ranked(scores.where(F.col("grade") <= min_grade), 0.0).where(F.col("rank") <= n)


def last_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("__n = 1").drop("__n")


