"""Live monitoring of strategies from their trade logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import loss_streaks


def rolling_metrics(log: DataFrame, n: int = 20, key: str = "strategy_id") -> DataFrame:
    """Sharpe, win rate, return, drawdown and losing streak of each strategy's last ``n`` trades (key, i, pnl, pnl_pct)."""
    back = Window.partitionBy(key).orderBy(F.desc("i"))
    recent = log.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).withColumn("r", F.col("pnl_pct") / 100)
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = recent.withColumn("cum", F.exp(F.sum(F.log1p("r")).over(w)))
    c = c.withColumn("dd", (F.greatest(F.max("cum").over(w), F.lit(1.0)) - F.col("cum")) / F.greatest(F.max("cum").over(w), F.lit(1.0)) * 100)
    a = c.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("r").alias("mu"), F.coalesce(F.stddev_samp("r"), F.lit(1e-8)).alias("sd"), F.avg((F.col("pnl") > 0).cast("int")).alias("win"), F.max_by("cum", "i").alias("cum"), F.max("dd").alias("dd"))
    streak = loss_streaks(log, "i", key).groupBy(key).agg(F.max_by("streak", "i").alias("streak"), F.count("*").alias("all_trades"))
    sharpe = F.when(F.col("sd") > 1e-10, F.col("mu") / F.col("sd") * F.sqrt(252 / F.col("n"))).otherwise(0.0)
    return a.join(streak, key).select(
        key, "all_trades", F.round(sharpe, 4).alias("sharpe"), F.round("win", 4).alias("win_rate"), F.round((F.col("cum") - 1) * 100, 4).alias("ret"), F.round("dd", 4).alias("max_dd"),
        F.col("streak").cast("long").alias("consec_losses"))


def named(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def degrade_rules(m: DataFrame) -> DataFrame:
    """Rules that an active strategy breaks; needs five trades."""
    five = F.col("all_trades") >= 5
    return m.withColumn("rules", named([
        ("R1", five & (F.col("sharpe") < 0)), ("R2", five & (F.col("win_rate") < 0.30) & (F.col("all_trades") >= 10)),
        ("R3", five & F.col("validation_sharpe").isNotNull() & (F.col("max_dd") > 2 * F.coalesce(F.nullif("live_max_dd", F.lit(0.0)), F.lit(5.0)))), ("R5", five & (F.col("consec_losses") >= 5))]))


def snapshot(strategies: DataFrame, short: DataFrame, long: DataFrame, as_of: Column) -> DataFrame:
    """Action of every active or degraded strategy: ok, degrade, recover or retire, with the rules behind it."""
    m = strategies.where(F.col("status").isin("active", "degraded")).join(short, "strategy_id", "left")
    m = m.join(long.select("strategy_id", F.col("sharpe").alias("long_sharpe"), F.col("max_dd").alias("long_dd"), F.col("all_trades").alias("long_n")), "strategy_id", "left")
    m = m.fillna(0.0, ["sharpe", "win_rate", "ret", "max_dd", "long_sharpe", "long_dd"]).fillna(0, ["all_trades", "consec_losses", "long_n"])
    down = degrade_rules(m).withColumnRenamed("rules", "down")
    out = named([
        ("E1", F.date_diff(as_of, "degraded_since") >= 60), ("E2", (F.col("long_n") >= 60) & (F.col("long_sharpe") < 0)), ("E3", F.col("long_dd") > 20),
        ("E4", F.col("validation_sharpe") - F.col("sharpe") > 1.5)])
    well = (F.col("sharpe") >= 0.3) & (F.col("win_rate") >= 0.40) & (F.col("consec_losses") < 3)
    active = F.col("status") == "active"
    rules = F.when(active, F.col("down")).when(well, F.array().cast("array<string>")).otherwise(out)
    s = down.withColumn("rules", rules)
    action = F.when(active & (F.size("rules") > 0), "degrade").when(~active & well, "recover").when(~active & (F.size("rules") > 0), "retire").otherwise("ok")
    return s.select("strategy_id", "status", action.alias("action"), F.array_join("rules", ",").alias("rules"), "sharpe", "win_rate", "ret", "max_dd", "consec_losses")
