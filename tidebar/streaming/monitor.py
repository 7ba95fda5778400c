"""Live monitoring of strategies: each trade of a stream is checked when it comes in, and strategies degrade, recover and retire.

Rules and figures are those of ``operators.monitoring``. A strategy's state is the list of its last trades and one row with its
status, since when it is degraded, and the figures of its last check; nothing is read again. That a strategy has been degraded for too long is
found by an event-time timer, so it fires for strategies that trade no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHECK = "strategy_id string, checked_at timestamp, i long, n long, sharpe double, win_rate double, ret double, max_dd double, consec_losses long, action string, rules string, status string"
LIFE = "status string, degraded_ms long, validation_sharpe double, live_max_dd double, n long, streak long, sharpe double, win_rate double, ret double, max_dd double"
FIGURES = ["sharpe", "win_rate", "ret", "max_dd"]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the checks; windows are counts of trades."""

    short: int = 20
    long: int = 60
    least_trades: int = 5
    least_win_rate: float = 0.30
    win_rate_trades: int = 10
    drawdown_times: float = 2.0
    usual_drawdown: float = 5.0
    losses: int = 5
    recover_sharpe: float = 0.3
    recover_win_rate: float = 0.40
    recover_losses: int = 3
    retire_days: int = 60
    retire_drawdown: float = 20.0
    retire_decay: float = 1.5


def rolling(r: np.ndarray, won: np.ndarray, new: int, window: int) -> dict[str, np.ndarray]:
    """Figures of the last ``window`` trades (fewer at the beginning) at each of the ``new`` last trades."""
    seen = lambda v: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), v]), window)[-new:]
    x, here = seen(r), ~np.isnan(seen(r))
    n, filled = here.sum(axis=1), np.where(here, seen(r), 0.0)
    mean = filled.sum(axis=1) / n
    spread = np.sqrt((np.where(here, x - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n - 1, 1))
    spread = np.where(n > 1, spread, 1e-8)
    growth = np.exp(np.cumsum(np.log1p(filled), axis=1))
    peak = np.maximum(np.maximum.accumulate(np.where(here, growth, 0.0), axis=1), 1.0)
    fall = np.where(here, (peak - growth) / peak, 0.0).max(axis=1) * 100
    sharpe = np.where(spread > 1e-10, mean / np.where(spread > 1e-10, spread, 1.0) * np.sqrt(252 / n), 0.0)
    found = {"sharpe": sharpe, "win_rate": np.nansum(seen(won.astype(float)), axis=1) / n, "ret": (growth[:, -1] - 1) * 100, "max_dd": fall}
    return {k: np.round(v, 4) for k, v in found.items()}


def losing_streaks(won: np.ndarray, before: int) -> np.ndarray:
    """Losses in a row up to each trade, ``before`` of them before the first."""
    at = np.arange(len(won))
    last_win = np.maximum.accumulate(np.where(won, at, -1))
    return np.where(last_win >= 0, at - last_win, at + 1 + before)


class Monitor(StatefulProcessor):
    """Keeps and checks one strategy."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trades = handle.getListState("trades", "pnl_pct double, won boolean")
        self.life = handle.getValueState("life", LIFE)

    def close(self) -> None:
        pass

    def deadline(self, life: dict[str, Any]) -> int | None:
        """When a degraded strategy has to go."""
        return None if life["status"] != "degraded" or life["degraded_ms"] is None else life["degraded_ms"] + self.rules.retire_days * DAY_MS

    def watch(self, life: dict[str, Any]) -> None:
        """Sets the timer of the deadline: it fires once the watermark is past it."""
        if self.deadline(life) is not None:
            self.handle.registerTimer(self.deadline(life) + 1)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        r = initialState.iloc[0]
        number = lambda v: None if pd.isna(v) else float(v)
        since = None if pd.isna(r["degraded_since"]) else int(pd.Timestamp(r["degraded_since"]).timestamp() * 1000)
        life = {"status": r["status"], "degraded_ms": since, "validation_sharpe": number(r["validation_sharpe"]), "live_max_dd": number(r["live_max_dd"]), "n": 0, "streak": 0} | dict.fromkeys(FIGURES, 0.0)
        self.life.update(tuple(life.values()))
        self.watch(life)

    def row(self, key: Any, life: dict[str, Any], at: int, i: int | None, action: str, rules: str) -> dict[str, Any]:
        return {"strategy_id": key[0], "checked_at": pd.Timestamp(at, unit="ms"), "i": i, "n": life["n"], **{f: life[f] for f in FIGURES}, "consec_losses": life["streak"], "action": action, "rules": rules, "status": life["status"]}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        life = self.read()
        if life and self.deadline(life) is not None and self.deadline(life) < expiredTimerInfo.getExpiryTimeInMs():
            at = self.deadline(life)
            life["status"] = "retired"
            self.life.update(tuple(life.values()))
            yield output([self.row(key, life, at, None, "retire", "E1")])

    def read(self) -> dict[str, Any] | None:
        found = self.life.get()
        return None if found is None else dict(zip([c.split()[0] for c in LIFE.split(", ")], found))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        life, new = self.read(), pd.concat(list(rows)).sort_values(["closed_at", "i"], kind="stable")
        if life is None or life["status"] not in ("active", "degraded"):
            return
        old = list(self.trades.get())
        r = np.array([t[0] for t in old] + new["pnl_pct"].tolist(), dtype=float) / 100
        won = np.array([t[1] for t in old] + (new["pnl"] > 0).tolist(), dtype=bool)
        yield from self.checked(key, life, new, r, won)
        self.trades.put([(float(x) * 100, bool(w)) for x, w in zip(r[-self.rules.long :], won[-self.rules.long :])])
        self.life.update(tuple(life.values()))

    def checked(self, key: Any, life: dict[str, Any], new: pd.DataFrame, r: np.ndarray, won: np.ndarray) -> Iterator[pd.DataFrame]:
        """Checks of the new trades; figures and rules of all of them at once, then from one change of status to the next."""
        k, m = self.rules, len(new)
        at, i = (new["closed_at"].astype("int64") // 1_000_000).to_numpy() if str(new["closed_at"].dtype).startswith("datetime64[ns") else new["closed_at"].map(lambda t: int(t.timestamp() * 1000)).to_numpy(), new["i"].to_numpy()
        near, far = rolling(r, won, m, k.short), rolling(r, won, m, k.long)
        n, streak, held = life["n"] + 1 + np.arange(m), losing_streaks(won[-m:], life["streak"]), life["validation_sharpe"]
        before = np.concatenate([[life["live_max_dd"] or 0.0], near["max_dd"][:-1]])
        enough = n >= k.least_trades
        down = {
            "R1": enough & (near["sharpe"] < 0), "R2": enough & (near["win_rate"] < k.least_win_rate) & (n >= k.win_rate_trades),
            "R3": enough & (held is not None) & (near["max_dd"] > k.drawdown_times * np.where(before == 0, k.usual_drawdown, before)), "R5": enough & (streak >= k.losses)}
        well = (near["sharpe"] >= k.recover_sharpe) & (near["win_rate"] >= k.recover_win_rate) & (streak < k.recover_losses)
        out = {"E2": (n >= k.long) & (far["sharpe"] < 0), "E3": far["max_dd"] > k.retire_drawdown, "E4": np.full(m, False) if held is None else held - near["sharpe"] > k.retire_decay}
        action, rules, status = np.full(m, "ok", object), np.full(m, "", object), np.full(m, life["status"], object)
        first = lambda test, p: p + int(np.argmax(test[p:])) if test[p:].any() else m
        fired, p, late = lambda tests, j: ",".join(name for name, test in tests.items() if test[j]), 0, None
        while p < m and life["status"] != "retired":
            if life["status"] == "active":
                j = first(np.logical_or.reduce(list(down.values())), p)
                change, why, to = "degrade", down, "degraded"
            else:
                limit = self.deadline(life)
                long = np.full(m, False) if limit is None else at >= limit
                gone = {"E1": long} | out
                j = min(first(well, p), first(np.logical_or.reduce(list(gone.values())), p))
                over = m if limit is None else first(at > limit, p)
                if over <= j and over < m:
                    late, status[p:], m = limit, "degraded", over
                    life["status"] = "retired"
                    break
                change, why, to = ("recover", {}, "active") if j < m and well[j] else ("retire", gone, "retired")
            status[p:j] = life["status"]
            if j < m:
                action[j], rules[j], status[j] = change, fired(why, j), to
                life["status"], life["degraded_ms"] = to, int(at[j]) if to == "degraded" else None if to == "active" else life["degraded_ms"]
                self.watch(life)
            p = j + 1
        end = m if life["status"] != "retired" or late is not None else p
        checks = pd.DataFrame({"strategy_id": key[0], "checked_at": pd.to_datetime(at[:end], unit="ms"), "i": i[:end], "n": n[:end], **{f: near[f][:end] for f in FIGURES}, "consec_losses": streak[:end], "action": action[:end], "rules": rules[:end], "status": status[:end]})
        if end:
            life |= {"n": int(n[end - 1]), "streak": int(streak[end - 1]), "live_max_dd": float(near["max_dd"][end - 1])} | {f: float(near[f][end - 1]) for f in FIGURES}
            yield output(checks)
        if late is not None:
            yield output([self.row(key, life, late, None, "retire", "E1")])


def output(rows: pd.DataFrame | list[dict[str, Any]]) -> pd.DataFrame:
    df = pd.DataFrame(rows)
    return df.astype({"i": "Int64", "checked_at": "datetime64[us]"})[[c.split()[0] for c in CHECK.split(", ")]]


def live_checks(trades: DataFrame, registry: DataFrame, rules: Rules = Rules(), lateness: str = "0 seconds") -> DataFrame:
    """Checks of a stream of closed trades (``strategy_id, closed_at, i, pnl, pnl_pct``) for the active and degraded strategies of ``registry``.

    One row per check: the figures of the last trades, ``action`` (ok, degrade, recover, retire), the ``rules`` behind it and the ``status`` after it. A strategy that
    has been degraded for ``retire_days`` is retired at that time, with a null ``i``, when a later time has been seen. Trades of a batch are taken in order of time and ``i``;
    those older than the watermark are dropped, those of retired or unknown strategies are not checked. ``registry`` has
    ``strategy_id, status, validation_sharpe, live_max_dd, degraded_since`` and is read when the stream begins. The session needs the RocksDB state store.
    """
    known = registry.where(F.col("status").isin("active", "degraded"))
    known = known.select("strategy_id", "status", F.col("validation_sharpe").cast("double"), F.col("live_max_dd").cast("double"), F.col("degraded_since").cast("timestamp")).dropDuplicates(["strategy_id"])
    stream = trades.select("strategy_id", F.col("closed_at").cast("timestamp").alias("closed_at"), "i", "pnl", "pnl_pct").withWatermark("closed_at", lateness)
    return stream.groupBy("strategy_id").transformWithStateInPandas(Monitor(rules), CHECK, "Append", "EventTime", initialState=known.groupBy("strategy_id"))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the state store that the monitor needs; the caller's settings stay as they are."""
    side = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        side.conf.set(key, spark.conf.get(key))
    side.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return side


def replay(trades: DataFrame, registry: DataFrame, root: str, cuts: list[str], rules: Rules = Rules()) -> DataFrame:
    """Runs a trade log through the live monitor, one run of the stream per period between ``cuts`` (dates), each going on from the checkpoint of the one before."""
    side = stateful_session(trades.sparkSession)
    registry.write.parquet(f"{root}/registry")
    known = side.read.schema(registry.schema).parquet(f"{root}/registry")
    bounds = [None, *cuts, None]
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = trades.where(F.lit(True) if lo is None else F.col("closed_at") >= lo).where(F.lit(True) if hi is None else F.col("closed_at") < hi)
        part.write.parquet(f"{root}/log/{k}")
        stream = side.readStream.schema(trades.schema).option("recursiveFileLookup", True).parquet(f"{root}/log")
        live_checks(stream, known, rules).writeStream.format("parquet").option("path", f"{root}/checks").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return trades.sparkSession.read.schema(CHECK).parquet(f"{root}/checks")
