"""Performance of equity curves and trade lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS, RISK_FREE = 252, 0.03 / 252


def curve_metrics(curve: DataFrame, capital: float = 100_000.0, key: str = "symbol") -> DataFrame:
    """Total return, Sharpe, Sortino, greatest drawdown and Calmar per key of (key, date, total)."""
    w = Window.partitionBy(key).orderBy("date")
    peak = F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = curve.select(key, "date", "total", (F.col("total") / F.lag("total").over(w) - 1).alias("r"), ((peak - F.col("total")) / peak * 100).alias("dd"))
    down = F.when(F.col("r") < RISK_FREE, F.col("r") - RISK_FREE)
    a = c.groupBy(key).agg(
        F.count("*").alias("n"), F.max_by("total", "date").alias("last"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.stddev_samp(down).alias("dsd"), F.max("dd").alias("dd"))
    ret = F.col("last") / capital - 1
    ratio = lambda sd: F.when(F.col(sd) > 0, (F.col("mu") - RISK_FREE) / F.col(sd) * (DAYS**0.5)).otherwise(0.0)
    calmar = F.when(F.col("dd") > 0, (F.pow(1 + ret, DAYS / F.col("n")) - 1) / (F.col("dd") / 100)).otherwise(0.0)
    return a.select(
        key, F.col("n").alias("n_days"), F.round(ret * 100, 4).alias("total_return_pct"), F.round(ratio("sd"), 4).alias("sharpe"), F.round(ratio("dsd"), 4).alias("sortino"),
        F.round("dd", 4).alias("max_drawdown_pct"), F.round(calmar, 4).alias("calmar"))


def trade_metrics(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Counts, win rate, profit factor, mean result and exit shares of closed trades per key."""
    won = F.col("pnl") > 0
    share = lambda c, v: F.round(F.avg(F.when(F.col(c) == v, 100.0).otherwise(0.0)), 4)
    gain, loss = F.sum(F.when(won, F.col("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(~won, F.col("pnl")).otherwise(0.0)))
    return trades.groupBy(key).agg(
        F.count("*").alias("total_trades"), F.count_if(won).alias("winning_trades"), F.round(F.avg(won.cast("int")), 6).alias("win_rate"),
        F.round(F.least(gain / (loss + 1e-8), F.lit(999.99)), 4).alias("profit_factor"), F.round(F.avg("pnl_pct"), 4).alias("avg_trade_pct"),
        share("exit_reason", "stop_loss").alias("stop_pct"), share("exit_reason", "target_reached").alias("target_pct"), share("exit_reason", "trailing_stop").alias("trail_pct"),
        share("exit_reason", "time_exit").alias("time_pct"))


def backtest_rows(symbols: DataFrame, trades: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per symbol: both kinds of metrics; symbols without trades have zeros and status ``skip``."""
    both = symbols.select("symbol").distinct().join(trade_metrics(trades), "symbol", "left").join(curve_metrics(curve), "symbol", "left")
    idle = F.col("total_trades").isNull()
    numbers = [c for c in both.columns if c != "symbol"]
    zero = lambda c: F.when(idle, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast(both.schema[c].dataType).alias(c)
    return both.select("symbol", *[zero(c) for c in numbers], F.when(idle, "skip").otherwise("ok").alias("status"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """Means, median and extremes over the symbols that traded."""
    active = rows.where("total_trades > 0")
    at = F.struct("total_return_pct", "symbol")
    return active.agg(
        F.count("*").alias("n_active"), F.sum("total_trades").alias("n_trades"), F.round(F.avg("win_rate"), 6).alias("avg_win_rate"), F.round(F.avg("total_return_pct"), 4).alias("avg_return"),
        F.round(F.median("total_return_pct"), 4).alias("median_return"), F.round(F.avg("max_drawdown_pct"), 4).alias("avg_drawdown"), F.round(F.avg(F.least("profit_factor", F.lit(100.0))), 4).alias("avg_profit_factor"),
        F.round(F.avg((F.col("total_return_pct") > 0).cast("int")) * 100, 4).alias("profitable_pct"), F.max_by("symbol", at).alias("best"), F.min_by("symbol", at).alias("worst"))
