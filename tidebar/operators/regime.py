"""Five-state market regime at every bar from trailing frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import row_no, clamp, frame, lag, signed_share, with_means

MIN_ROWS = 130
#: Greatest position and number of positions by regime.
MAX_POSITION = {"policy_bottom": 0.90, "bull_trend": 0.80, "structural": 0.50, "stock_game": 0.20, "systemic_risk": 0.00}
MAX_POSITIONS = {"policy_bottom": 5, "bull_trend": 4, "structural": 3, "stock_game": 2, "systemic_risk": 0}


#: Names shown for the regimes.
LABELS = {"policy_bottom": "policy bottom", "bull_trend": "bull trend", "structural": "structural market", "stock_game": "stock game", "systemic_risk": "systemic risk"}


def lookup(values: dict, key: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(key) if isinstance(key, str) else key]


#: Strict means that the scores read.
MEANS = {
    "m20": ("close", -19, 0), "m60": ("close", -59, 0), "m120": ("close", -119, 0), "v_now": ("volume", -9, 0), "v_base": ("volume", -29, -10), "v_before": ("volume", -19, -10),
}


def past_return(n: int) -> Column:
    return F.coalesce(F.col("close") / F.col(f"c{n}") - 1, F.lit(0.0))


def trend_score() -> Column:
    c, m20, m60, m120 = F.col("close"), F.col("m20"), F.col("m60"), F.col("m120")
    holds = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    base = 0.30 * holds(c > m20) + 0.25 * holds(c > m60) + 0.20 * holds(c > m120) + 0.25 * holds((m20 > m60) & (m60 > m120))
    slope = (c - F.col("c19")) / (F.col("c19") + 1e-8)
    return clamp(base + F.when(slope > 0.05, 0.1).when(slope < -0.05, -0.1).otherwise(0.0))


def volume_score() -> Column:
    now, base, before = F.col("v_now"), F.col("v_base"), F.col("v_before")
    ratio = now / (base + 1e-8)
    level = (
        F.when(ratio >= 1.5, F.least(F.lit(1.0), 0.5 + 0.5 * F.least(ratio - 1, F.lit(1.0))))
        .when(ratio <= 0.7, F.greatest(F.lit(0.0), 0.5 * ratio / 0.7)).otherwise(0.5 + (ratio - 1) * 0.5 / 0.5)
    )
    trend = (now - before) / (before + 1e-8)
    moved = F.when(trend > 0.1, F.least(F.lit(1.0), level + 0.05)).when(trend < -0.1, F.greatest(F.lit(0.0), level - 0.05)).otherwise(level)
    return F.when(F.col("rn") >= 30, moved).otherwise(0.5)


def momentum_score() -> Column:
    return clamp(0.5 + 0.20 * signed_share(past_return(5), 0.05) + 0.30 * signed_share(past_return(20), 0.10) + 0.20 * signed_share(past_return(60), 0.20))


def risk_score() -> Column:
    ret = F.col("close") / F.coalesce("c19", "c_first") - 1
    vol = F.when(F.col("rn") >= 31, F.col("spread") * (252**0.5)).otherwise(0.0)
    return F.when(ret < -0.08, 0.1).when(ret > 0.15, 0.8).otherwise(clamp(0.7 - vol * 0.5, 0.1, 0.9))


def scores(bars: DataFrame, keep: tuple[str, ...] = (), frames: dict[str, str] | None = None) -> DataFrame:
    """The five scores of every bar. Each frame is a column of its own that the formulas read; ``frames`` (``new name: name``) are given out as a struct ``frames``."""
    c = F.col("close")
    b = bars.select("symbol", "date", "close", "volume", F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), ((c - F.col("low")) / (F.col("high") - F.col("low") + 1e-8)).alias("at"), ((c - lag("close")) / (lag("close") + 1e-8)).alias("day_ret"))
    b = with_means(b.withColumn("rn", row_no()), MEANS).withColumns({
        **{f"c{n}": lag("close", n) for n in (5, 19, 20, 60)}, "c_first": F.first("close").over(frame(-19)), "breadth": F.avg("at").over(frame(-19)), "spread": F.stddev_pop("day_ret").over(frame(-28))})
    back = [F.col("kept")[k].alias(k) for k in keep]
    given = [F.struct(*[F.col(c).alias(k) for k, c in frames.items()]).alias("frames")] if frames else []
    return b.select("symbol", "date", *back, *given, "rn", trend_score().alias("trend"), volume_score().alias("vol"), momentum_score().alias("mom"), "breadth", risk_score().alias("risk"))


def classify(s: DataFrame) -> DataFrame:
    """Regime, confidence and caps from unrounded scores; short histories get the default."""
    t, v, m, r = (F.col(c) for c in ("trend", "vol", "mom", "risk"))
    bottom, bull, game = (t < 0.25) & (v > 0.65) & (m > 0.35) & (r > 0.5), (t > 0.70) & (v > 0.60) & (m > 0.65), (v < 0.35) & (t < 0.55)
    short = F.col("rn") < MIN_ROWS
    regime = F.when(short, "structural").when(r < 0.15, "systemic_risk").when(bottom, "policy_bottom").when(bull, "bull_trend").when(game, "stock_game").otherwise("structural")
    confidence = (
        F.when(short, 0.3).when(r < 0.15, 1 - r * 5).when(bottom, F.least((1 - t) * v * 0.7 + r * 0.3, F.lit(0.95)))
        .when(bull, F.least((t + v + m) / 3, F.lit(0.95))).when(game, F.least((1 - v) * 0.6 + (1 - t) * 0.4, F.lit(0.90)))
        .otherwise(F.least(F.abs(t - 0.5) * 2 * 0.3 + F.abs(v - 0.5) * 0.2 + 0.5, F.lit(0.85)))
    )
    out = s.withColumn("regime", regime).withColumn("confidence", confidence)
    return out.withColumn("max_position", F.when(short, 0.30).otherwise(lookup(MAX_POSITION, "regime"))).withColumn(
        "max_positions", F.when(short, 2).otherwise(lookup(MAX_POSITIONS, "regime")).cast("int")).withColumn("tradeable", F.col("regime") != "systemic_risk")


def detect(bars: DataFrame, keep: tuple[str, ...] = (), frames: dict[str, str] | None = None) -> DataFrame:
    """Regime of every bar; the columns of ``keep`` stay, so that more frames follow over the same sorted rows. ``frames`` as in ``scores``."""
    return classify(scores(bars, keep, frames))
