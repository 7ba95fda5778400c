"""Strategy registry as two tables: strategies and an append-only log of transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions.
EDGES = {"candidate": ["shadow", "retired"], "shadow": ["active", "retired"], "active": ["degraded", "retired"], "degraded": ["active", "retired"], "retired": []}


def strategy_id(name: Column, style: Column, params_json: Column) -> Column:
    """First letters of the style and a digest of name, style and sorted parameters."""
    return F.concat(F.substring(style, 1, 3), F.lit("_"), F.substring(F.md5(F.concat_ws(":", name, style, params_json)), 1, 8))


def params_text(params: Column) -> Column:
    """A string-to-JSON-value map as JSON text with sorted keys, one blank after each comma and colon."""
    entries = F.array_sort(F.map_entries(params))
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), e["value"])), ", ")
    return F.concat(F.lit("{"), text, F.lit("}"))


def allowed(a: Column, b: Column) -> Column:
    test = F.lit(False)
    for start, ends in EDGES.items():
        if ends:
            test = test | ((a == start) & b.isin(*ends))
    return test


def violations(log: DataFrame) -> DataFrame:
    """Transitions (strategy_id, at, to_status) that are not allowed from the status before."""
    w = Window.partitionBy("strategy_id").orderBy("at")
    t = log.withColumn("from_status", F.coalesce(F.lag("to_status").over(w), F.lit("candidate")))
    return t.where(~allowed(F.col("from_status"), F.col("to_status")) & ~((F.col("from_status") == "candidate") & (F.col("to_status") == "candidate")))


def current_status(log: DataFrame) -> DataFrame:
    return log.groupBy("strategy_id").agg(
        F.max_by("to_status", "at").alias("status"), F.max(F.when(F.col("to_status") == "retired", F.col("at"))).alias("retired_at"))


def recommended(strategies: DataFrame) -> DataFrame:
    """The best active strategy, else the best degraded one, else none."""
    score = F.coalesce("live_sharpe", F.nullif("validation_sharpe", F.lit(0.0)), F.lit(-999.0))
    fallback = F.coalesce(F.nullif("live_sharpe", F.lit(0.0)), F.lit(-999.0))
    tier = F.when(F.col("status") == "active", 1).when(F.col("status") == "degraded", 2)
    s = strategies.withColumn("tier", tier).where("tier is not null").withColumn("pick", F.when(F.col("tier") == 1, score).otherwise(fallback))
    return s.orderBy("tier", F.desc("pick"), "strategy_id").limit(1).select("strategy_id", "status", "pick")


def rotation(strategies: DataFrame) -> DataFrame:
    """Score of every active strategy; zero counts as missing."""
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0)), F.lit(0.0))
    score = (
        first("live_sharpe", "validation_sharpe") * 0.4 + first("live_win_rate", "validation_win_rate") * 100 * 0.3
        + first("live_ret_pct", "validation_ret_pct") * 0.2 + F.coalesce("validation_win_rate", F.lit(0.0)) * 100 * 0.1
    )
    return strategies.where("status = 'active'").select("strategy_id", F.round(score, 4).alias("score"))


def pool_summary(strategies: DataFrame) -> DataFrame:
    return strategies.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("strategy_id")), ",").alias("ids"))


def pool_report(strategies: DataFrame) -> DataFrame:
    """One row over all strategies: counts, the ids of active, degraded and retired ones, and the recommended one with its live Sharpe."""
    ids = lambda status: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.col("strategy_id")))), ",").alias(f"{status}_ids")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in EDGES]
    all_ = strategies.agg(F.count("*").alias("total"), *counts, ids("active"), ids("degraded"), ids("retired"))
    best = recommended(strategies).join(strategies.select("strategy_id", "live_sharpe"), "strategy_id").agg(F.first("strategy_id").alias("best_id"), F.first("live_sharpe").alias("best_sharpe"))
    return all_.join(best, F.lit(True))


def record_trades(trades: DataFrame, path: str) -> DataFrame:
    """Appends closed trades (``strategy_id, i, closed_at, pnl, pnl_pct, exit_reason``) to the log at ``path``: what it holds already by strategy and ``i`` is not put in again.

    The log is what the monitor reads, as a table or as a stream. Only the log's keys are read for the check. Returns the log.
    """
    spark = trades.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    new = trades.dropDuplicates(["strategy_id", "i"])
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.schema(trades.schema).parquet(path).select("strategy_id", "i"), ["strategy_id", "i"], "left_anti").select(*trades.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(trades.schema).parquet(path)


def register_new(strategies: DataFrame, offered: DataFrame) -> DataFrame:
    """Strategies with the offered ones (name, style, params_json) added as candidates; known ids are skipped, of equal offers one is taken."""
    new = offered.select(strategy_id(F.col("name"), F.col("style"), F.col("params_json")).alias("strategy_id"), "name", "style", F.lit("candidate").alias("status"))
    return strategies.unionByName(new.dropDuplicates(["strategy_id"]).join(strategies.select("strategy_id"), "strategy_id", "left_anti"))


def with_validation_log(log: DataFrame, strategies: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """The transition log with a row for each status that the validation results change."""
    before = strategies.select("strategy_id", F.col("status").alias("was"))
    after = apply_validation(strategies, results).select("strategy_id", F.col("status").alias("to_status"))
    changed = after.join(before, "strategy_id").where("to_status <> was").select("strategy_id", at.alias("at"), "to_status")
    return log.select("strategy_id", "at", "to_status").unionByName(changed)


def with_notes(strategies: DataFrame, notes: DataFrame) -> DataFrame:
    """Appends each strategy's dated notes (strategy_id, at, note) in order of date, then text."""
    line = F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd"), "note")
    added = notes.groupBy("strategy_id").agg(F.sort_array(F.collect_list(line)).alias("notes"))
    return strategies.join(added, "strategy_id", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def apply_validation(strategies: DataFrame, results: DataFrame) -> DataFrame:
    """Merges validation results (strategy_id, passed, sharpe): passed becomes active, failed retired; others stay."""
    r = results.select("strategy_id", F.col("passed").alias("ok"), F.col("sharpe").alias("new_sharpe"))
    s = strategies.join(r, "strategy_id", "left")
    return s.withColumn("status", F.when(F.col("ok"), "active").when(~F.col("ok"), "retired").otherwise(F.col("status"))).withColumn(
        "validation_sharpe", F.coalesce("new_sharpe", "validation_sharpe")).drop("ok", "new_sharpe")
