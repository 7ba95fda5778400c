"""Trade signals: stop, target, type, confidence and size at every bar, and the resulting action."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import row_no, clamp, frame, lag, settled
from . import detectors, factors, indicators, regime

MIN_SERIES = 30


@dataclass(frozen=True)
class Preset:
    """Parameters of a trading style."""

    style: str = "base"
    max_holding_days: int = 20
    min_stop_pct: float = 0.04
    max_stop_pct: float = 0.09
    atr_stop_mult: float = 2.0
    target_lookback: int = 30
    target_buffer: float = 0.02
    min_rr_ratio: float = 1.3
    trail_activation: float = 0.06
    trail_pct: float = 0.04
    breakeven_pct: float = 0.04
    min_factor_score: float = 55.0
    min_confidence: float = 0.45
    max_positions: int = 5
    base_position_pct: float = 0.20
    commission: float = 0.0003
    stamp_tax: float = 0.001
    slippage: float = 0.001


BASE = Preset()
#: The three style presets.
STYLES = [
    Preset("short_term", 5, 0.03, 0.05, 1.5, 10, 0.01, 1.5, 0.04, 0.02, 0.02, 50.0, 0.42, 3),
    Preset("swing", 20, 0.05, 0.08, 2.0, 30, 0.02, 1.8, 0.06, 0.03, 0.04, 55.0, 0.45, 4),
    Preset("medium_term", 60, 0.06, 0.12, 2.5, 60, 0.03, 2.5, 0.10, 0.05, 0.06, 62.0, 0.50, 3),
]
BOOST = {"policy_bottom": 0.10, "bull_trend": 0.05, "structural": 0.0, "stock_game": -0.05, "systemic_risk": 0.0}


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([asdict(s) for s in STYLES])


def price_frames(bars: DataFrame, lookback: int = 30, keep: tuple[str, ...] = (), lookbacks: tuple[int, ...] = ()) -> DataFrame:
    """What a signal reads of prices and volumes at each bar. Frames are as long as the history allows; ``lookbacks`` add a ``prev_high_N`` each."""
    b = bars.withColumn("tr", indicators.true_range())
    vol_base = F.when(row_no() >= 20, F.avg("volume").over(frame(-19, -5))).otherwise(F.avg("volume").over(frame(-19)))
    return b.select(
        "symbol", "date", "close", *keep, row_no().alias("n"), F.avg("tr").over(frame(-13)).alias("atr"), F.min("low").over(frame(-4)).alias("low5"),
        F.max("high").over(frame(-lookback, -1)).alias("prev_high"), *[F.max("high").over(frame(-n, -1)).alias(f"prev_high_{n}") for n in lookbacks], F.max("high").over(frame(-60, -1)).alias("high60"),
        (F.avg("volume").over(frame(-4)) / (vol_base + 1e-8)).alias("vr"), F.coalesce(F.col("close") / lag("close", 5) - 1, F.lit(0.0)).alias("ret5"))


def stop_loss(p: Preset) -> Column:
    c = F.col("close")
    raw = F.least(c - p.atr_stop_mult * F.col("atr"), F.col("low5") * 0.99)
    return settled(F.least(F.greatest(raw, c * (1 - p.max_stop_pct)), c * (1 - p.min_stop_pct)), 3)


def target_price(p: Preset) -> Column:
    c, high = F.col("close"), F.col("prev_high")
    far = F.greatest(F.col("high60") * (1 - p.target_buffer), c * 1.08)
    target = F.when(c >= high * 0.98, far).otherwise(high * (1 - p.target_buffer))
    return settled(F.when(target <= c * 1.02, c * (1 + max(p.min_stop_pct * p.min_rr_ratio, 0.05))).otherwise(target), 3)


def signal_type() -> Column:
    vr, r = F.col("vr"), F.col("ret5")
    return (
        F.when((vr >= 1.8) & (r > 0.03), "volume_surge").when(r > 0.04, "momentum_breakout")
        .when((r >= -0.03) & (r <= 0.01), "pullback_entry").otherwise("trend_continuation")
    )


def confidence(p: Preset) -> Column:
    base = 0.45 + (F.col("total_score") - p.min_factor_score) / 90 * 0.50
    return settled(clamp(base + regime.lookup(BOOST, "regime"), 0.45, 0.95), 3)


def position_pct(p: Preset) -> Column:
    cap = F.col("max_position")
    size = cap * (0.5 + F.col("confidence") * F.least(F.col("rr") / 2, F.lit(1.0)) * 0.5)
    return settled(F.least(size, F.lit(p.base_position_pct * 2), cap / F.greatest(F.col("max_positions"), F.lit(1))), 4)


def with_signal(df: DataFrame, p: Preset = BASE) -> DataFrame:
    """Adds the signal columns to rows with price frames, regime and score; ``generated`` marks rows that pass the gates, ``valid`` those that trade."""
    df = df.withColumn("stop", stop_loss(p)).withColumn("target", target_price(p))
    df = df.withColumn("rr", (F.col("target") - F.col("close")) / (F.col("close") - F.col("stop") + 1e-8))
    df = df.withColumn("signal_type", signal_type()).withColumn("confidence", confidence(p)).withColumn("position_pct", position_pct(p))
    df = df.withColumn("entry", settled(F.col("close") * (1 + p.commission + p.slippage), 3))
    gates = F.col("passed") & (F.col("total_score") >= p.min_factor_score) & F.col("tradeable") & (F.col("n") >= MIN_SERIES)
    made = F.coalesce(gates & (F.col("rr") >= p.min_rr_ratio) & (F.col("confidence") >= p.min_confidence), F.lit(False))
    own_rr = (F.col("target") - F.col("entry")) / (F.col("entry") - F.col("stop") + 1e-8)
    sound = (F.col("stop") < F.col("entry")) & (F.col("entry") < F.col("target")) & (own_rr >= 1.3) & (F.col("confidence") >= 0.45)
    return df.withColumn("generated", made).withColumn("valid", F.col("generated") & sound)


def context(bars: DataFrame) -> DataFrame:
    """The bars with regime and score; the score reads the RSI of the whole history. All frames run over one sort of the bars, those that both read once; nothing is joined."""
    prices = ("open", "high", "low", "close", "volume")
    r = regime.detect(bars, prices, factors.SHARED).select("symbol", "date", *prices, "frames", F.struct(*REGIME).alias("r"))
    return factors.score(indicators.with_wilder_rsi(r), ("open", "high", "low", "r"), "rsi14", tuple(factors.SHARED)).select("symbol", "date", *prices, "r.*", *SCORE)


#: What a signal reads of regime and score.
REGIME, SCORE = ("regime", "max_position", "max_positions", "tradeable"), ("total_score", "passed", "grade")


def signals(bars: DataFrame, p: Preset = BASE) -> DataFrame:
    """The signal evaluated at every bar from that bar's own prices, regime and score."""
    return with_signal(price_frames(context(bars), p.target_lookback, REGIME + SCORE), p)


def actions(bars: DataFrame, p: Preset = BASE) -> DataFrame:
    """AVOID, BUY, WATCH or HOLD with its confidence, nudged by the combined indicator signal."""
    votes = indicators.signals(indicators.calculate_all(bars)).select("symbol", "date", "decision")
    s = signals(bars, p).withColumnRenamed("confidence", "signal_confidence").join(votes, ["symbol", "date"])
    nudge = F.when(F.col("decision") == "buy", 0.03).when(F.col("decision") == "sell", -0.03).otherwise(0.0)
    short = F.col("n") < 60
    watch = (F.col("total_score") >= 55) & F.col("tradeable")
    action = (
        F.when(short | ~F.col("tradeable") | ~F.col("passed"), "AVOID").when(F.col("valid"), "BUY").when(watch, "WATCH").when(F.col("total_score") >= 45, "HOLD").otherwise("AVOID")
    )
    sure = (
        F.when(short, 0.0).when(~F.col("tradeable"), 0.9).when(~F.col("passed"), 0.8).when(F.col("valid"), F.least(F.lit(0.95), F.col("signal_confidence") + nudge))
        .when(watch, F.least(F.lit(0.75), 0.55 + nudge)).when(F.col("total_score") >= 45, 0.4).otherwise(0.7)
    )
    return s.withColumn("action", action).withColumn("action_confidence", settled(sure, 3))


#: The signal type that each detector stands for.
TYPE_OF = {
    "limit_up_follow": "momentum_breakout", "gap_up_breakout": "momentum_breakout", "ma_golden_cross": "trend_continuation", "intraday_surge": "volume_surge",
    "swing_breakout": "momentum_breakout", "pullback_ma": "pullback_entry", "volume_divergence": "pullback_entry", "bollinger_breakout": "momentum_breakout",
}


def style_signals(bars: DataFrame, p: Preset, limit: Column | None = None) -> DataFrame:
    """Signals of a trading style: the base signal raised by the style's best detector, or one built from the detector alone.

    One row per bar that has a signal: ``symbol, date, signal_type, detector, confidence, position_pct, entry, stop, target, rr``.
    """
    best = detectors.best_signal(detectors.detect_all(bars, limit), (p.style,)).select("symbol", "date", F.col("signal").alias("detector"), "strength")
    s = signals(bars, p).join(best, ["symbol", "date"], "left")
    seen, strength = F.col("detector").isNotNull(), F.col("strength")
    raised = settled(F.greatest(F.col("confidence"), strength * 0.9), 3)
    size = F.col("max_position") * (0.5 + strength * F.least(F.col("rr") / 2, F.lit(1.0)) * 0.5)
    size = settled(F.least(size, F.lit(p.base_position_pct * 2), F.col("max_position") / F.greatest(F.col("max_positions"), F.lit(1))), 4)
    own_rr = (F.col("target") - F.col("entry")) / (F.col("entry") - F.col("stop") + 1e-8)
    sound = (F.col("stop") < F.col("entry")) & (F.col("entry") < F.col("target")) & (own_rr >= 1.3) & (strength >= 0.45)
    alone = (strength >= p.min_confidence) & F.col("passed") & (F.col("total_score") >= p.min_factor_score) & F.col("tradeable") & (F.col("rr") >= p.min_rr_ratio) & sound
    own = seen & ~F.col("valid")
    return s.where(F.when(own, alone).when(seen, F.lit(True)).otherwise(F.col("generated"))).select(
        "symbol", "date", F.when(own, regime.lookup(TYPE_OF, "detector")).otherwise(F.col("signal_type")).alias("signal_type"), "detector",
        F.when(own, settled(strength, 3)).when(seen, raised).otherwise(F.col("confidence")).alias("confidence"),
        F.when(own, size).otherwise(F.col("position_pct")).alias("position_pct"), "entry", "stop", "target", "rr")
