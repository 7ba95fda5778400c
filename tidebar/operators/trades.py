"""Trade paths over one ordered series per symbol: candidates, first exits, and the account that trades them."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import by_date, fold_series, row_no, settled
from . import detectors, entries
from .strategy import BASE, Preset

WARM_UP, GRID, MIN_HOLD = 130, 10, 3


def indexed(bars: DataFrame, limit: Column | None = None) -> DataFrame:
    """Bars with the 0-based index ``i`` and limit flags."""
    return detectors.limit_flags(bars, limit, tuple(c for c in bars.columns if c not in ("symbol", "date"))).withColumn("i", (row_no() - 1).cast("long"))


def candidate_rows(bars: DataFrame, presets: list[Preset] | None = None, limit: Column | None = None) -> DataFrame:
    """Every bar (``symbol, date, i, high, low, close, limit_down, last``) with the possible entry of each preset in ``c0, c1, ...``, null where there is none.

    Bar i trades on the prices of bar i - 1 and on regime and score of the last grid bar before it. Everything, for any
    number of presets, comes from frames over one sort of the bars, and rows stay in that order.
    """
    return entries.with_entries(bars, presets or [BASE], GRID, WARM_UP, limit)


def candidates(bars: DataFrame, p: Preset = BASE, limit: Column | None = None) -> DataFrame:
    """Possible entries, one row each."""
    return candidate_rows(bars, [p], limit).where("c0 is not null").select("symbol", "date", "i", "c0.*")


def in_series(rows: DataFrame) -> DataFrame:
    """Rows in order of symbol and date, a symbol's in one task, with ``last`` at its end. Those with that column are in order already, as ``candidate_rows`` leaves them."""
    if "last" in rows.columns:
        return rows
    return rows.withColumn("last", F.lead("date").over(by_date()).isNull()).sortWithinPartitions("symbol", "date")


def in_order(numbered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands on batches; where rows are ``numbered`` from 0 in each symbol, any that are out of order are an error."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended, index = True, -1
        for batch in batches:
            if numbered and batch.num_rows:
                i, last = (batch[c].to_numpy(zero_copy_only=False) for c in ("i", "last"))
                if not np.array_equal(i, np.where(np.concatenate([[ended], last[:-1]]), 0, np.concatenate([[index], i[:-1]]) + 1)):
                    raise ValueError("rows are not in order of symbol and date")
                ended, index = bool(last[-1]), int(i[-1])
            yield batch

    return checked


def exit_fold(p: Preset, numbered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of bars in order of symbol and date to the candidates in them with their first exits.

    All candidates of a batch take their steps together, one bar of their paths at a time. Rows from the first candidate whose path is not yet complete are carried to the next batch.
    """
    min_hold, longest, activation, trail_pct, breakeven, checked = MIN_HOLD, p.max_holding_days, p.trail_activation, p.trail_pct, p.breakeven_pct, in_order(numbered)
    reasons = ["stop_loss", "time_exit", "trailing_stop", "target_reached", "end_of_backtest"]

    def numbers(column: pa.Array) -> np.ndarray:
        return pc.fill_null(column.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, done = None, np.zeros(0, bool)
        for batch in checked(batches):
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            rows = table.to_batches()[0]
            size, i = rows.num_rows, rows["i"].to_numpy(zero_copy_only=False)
            high, low, price = (numbers(rows[c]) for c in ("high", "low", "close"))
            last, down = (rows[c].to_numpy(zero_copy_only=False) for c in ("last", "limit_down"))
            free = np.array([x is False for x in down]) if down.dtype == object else ~down
            # The end of each row's symbol, ``size`` where it is still to come, and the first tradable row from each one on.
            ends = np.append(np.flatnonzero(last), size)
            end = ends[np.searchsorted(ends, np.arange(size))]
            following = np.append(np.flatnonzero(free), size)
            following = np.append(following[np.searchsorted(following, np.arange(size))], size)
            done = np.concatenate([done, np.zeros(batch.num_rows, bool)])
            at = np.flatnonzero(rows["c0"].is_valid().to_numpy(zero_copy_only=False) & ~done)
            late = following[np.minimum(at + max(longest, min_hold), size)]
            late = np.where(late > end[at], size, late)
            ready = (late < size) | (end[at] < size)
            waits, at, late = at[~ready], at[ready], late[ready]
            c = rows["c0"].take(pa.array(at))
            e, stop, target = (numbers(c.field(name)) for name in ("entry", "stop", "target"))
            top, safe, trails = e.copy(), np.zeros(len(at), bool), np.zeros(len(at), bool)
            out_at, out_price, why = np.full(len(at), -1), np.full(len(at), math.nan), np.full(len(at), 4)
            with np.errstate(all="ignore"):
                for step in [*range(min_hold, longest), None]:
                    x = late if step is None else at + step
                    live = np.flatnonzero((out_at < 0) & (x <= np.minimum(end[at], size - 1)))
                    live = live[free[x[live]]]
                    y = x[live]
                    top[live] = np.fmax(top[live], high[y])
                    profit = (price[y] - e[live]) / e[live]
                    trails[live] |= profit >= activation
                    at_stop = np.where(safe[live] & (stop[live] < e[live]), e[live], stop[live])
                    trail = top[live] * (1 - trail_pct)
                    tests = [low[y] <= at_stop, i[y] - i[at[live]] >= longest, trails[live] & (low[y] <= trail), price[y] >= target[live]]
                    kind = np.select(tests, [0, 1, 2, 3], 4)
                    hit = kind < 4
                    out_at[live[hit]], why[live[hit]] = y[hit], kind[hit]
                    out_price[live[hit]] = np.select([kind == 0, kind == 2], [at_stop, trail], price[y])[hit]
                    safe[live] |= profit >= breakeven
            closing = np.minimum(end[at], size - 1)
            where = np.where(out_at < 0, closing, out_at)
            raw = np.where(np.isnan(out_price), price[closing], out_price)
            done[at] = True
            if len(at):
                own = rows.select(["symbol", "date", "i"]).take(pa.array(at))
                columns = dict(zip(own.schema.names, own.columns)) | {f.name: c.field(n) for n, f in enumerate(c.type)} | {
                    "exit_i": rows["i"].take(pa.array(where)), "exit_date": rows["date"].take(pa.array(where)), "exit_raw": pa.array(raw, pa.float64(), from_pandas=True), "exit_reason": pa.array(reasons).take(pa.array(why))}
                yield pa.RecordBatch.from_pydict(columns)
            first = int(waits[0]) if len(waits) else size
            rest, done = rows.slice(first), done[first:]

    return folded


def exits(rows: DataFrame, p: Preset = BASE) -> DataFrame:
    """First exit of every candidate ``c0`` of ``candidate_rows``: its columns, ``exit_i, exit_date, exit_raw, exit_reason``.

    A path is the tradable bars from the least holding time on, closed by the first tradable bar at or after the longest one, walked in the task and the order of the rows (``in_series``).
    """
    numbered, own = "last" in rows.columns, rows.schema["c0"].dataType.fields
    inputs = in_series(rows).select("symbol", "date", "i", "high", "low", "close", "limit_down", "last", "c0")
    found = [*[rows.schema[c] for c in ("symbol", "date", "i")], *own, T.StructField("exit_i", rows.schema["i"].dataType), T.StructField("exit_date", rows.schema["date"].dataType), T.StructField("exit_raw", T.DoubleType()), T.StructField("exit_reason", T.StringType())]
    return inputs.mapInArrow(exit_fold(p, numbered), T.StructType(found))


def first_exits(entries: DataFrame, bars: DataFrame, p: Preset = BASE, limit: Column | None = None) -> DataFrame:
    """``exits`` of given entries (``symbol, i, entry, stop, target`` and any others), at most one per bar."""
    own = [c for c in entries.columns if c not in ("symbol", "i", "date")]
    rows = indexed(bars, limit).select("symbol", "date", "i", "high", "low", "close", "limit_down")
    return exits(rows.join(entries.select("symbol", "i", F.struct(*own).alias("c0")), ["symbol", "i"], "left"), p)


def ledger(paths: DataFrame, capital: float = 100_000.0, p: Preset = BASE) -> DataFrame:
    """Trades taken from given paths one at a time per symbol: by entry index, each when the one before is closed and a lot is affordable.

    What is closed as ``end_of_backtest`` is held through the last bar, so that bar takes no other entry.
    """
    net = settled(F.col("exit_raw") - F.col("exit_raw") * (p.commission + p.stamp_tax), 3)
    priced = paths.withColumn("exit_price", net)

    def step(s: Column, c: Column) -> Column:
        lots = (F.floor(s["capital"] * c["position_pct"] / c["entry"] / 100) * 100).cast("long")
        take = (c["date"] >= s["free"]) & (lots >= 100) & (lots * c["entry"] <= s["capital"])
        left = s["capital"] - lots * c["entry"]
        return F.struct(
            F.when(take, c["exit_i"] + (c["exit_reason"] == "end_of_backtest").cast("int")).otherwise(s["free"]).alias("free"), F.when(take, left + lots * c["exit_price"]).otherwise(s["capital"]).alias("capital"),
            F.when(take, lots).alias("quantity"), left.alias("cash_in"))

    flat = F.struct(F.lit(-1).cast("long").alias("free"), F.lit(capital).alias("capital"), F.lit(None).cast("long").alias("quantity"), F.lit(capital).alias("cash_in"))
    taken = fold_series(priced.withColumn("date", F.col("i")), ["exit_i", "exit_reason", "entry", "exit_price", "position_pct"], lambda x: step(flat, x), step).where("quantity is not null")
    taken = taken.select("symbol", F.col("date").alias("i"), "quantity", "cash_in", F.col("capital").alias("cash_out"))
    return with_results(priced.join(taken, ["symbol", "i"]))


def with_results(trades: DataFrame) -> DataFrame:
    pnl = (F.col("exit_price") - F.col("entry")) / F.col("entry") * 100
    return trades.withColumn("pnl_pct", pnl).withColumn("pnl", F.col("pnl_pct") / 100 * F.col("entry") * F.col("quantity"))


@dataclass(frozen=True)
class Risk:
    """Adding to winners, and what stops new orders: a drawdown for good, a losing streak for some bars."""

    add_gain: float = 0.05
    add_share: float = 0.50
    most_adds: int = 1
    break_drawdown: float = 0.08
    losses: int = 3
    pause: int = 3


#: A position, and a trade once it is closed.
POSITION = "i bigint, signal_type string, position_pct double, cash_in double, adds int, entry double, stop double, target double, quantity bigint, top double, trails boolean"
TRADE = "i bigint, signal_type string, position_pct double, entry double, quantity bigint, adds int, cash_in double, cash_out double, exit_i bigint, exit_date date, exit_raw double, exit_price double, exit_reason string"
RISK_STATE = "peak double, broken boolean, losses int, pause int"
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "date": pa.date32()}


def arrow_fields(schema: str) -> list[pa.Field]:
    return [pa.field(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def account_fold(presets: list[Preset], capital: float, risk: Risk | None, numbered: bool = False, every: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of bars in order of symbol and date to the states of each preset's account after every bar: exit, entry, and with ``risk`` the breaker and adds.

    A symbol may span batches; only the open accounts are carried from one batch to the next. Missing prices are NaN here, which passes no test.
    """
    plain = [{k: getattr(p, k) for k in ("style", "max_holding_days", "trail_activation", "trail_pct", "breakeven_pct", "commission", "slippage", "min_stop_pct")} | {"fees": p.commission + p.stamp_tax} for p in presets]
    rules = asdict(risk) if risk else None
    held_fields, trade_fields, risk_fields, min_hold, milli = arrow_fields(POSITION), arrow_fields(TRADE), arrow_fields(RISK_STATE), MIN_HOLD, Decimal("0.001")
    checked = in_order(numbered)

    def settle(x: float) -> float:
        """``settled`` to three places: by the shortest decimal text, halves up."""
        return float(Decimal(repr(x + 1e-9)).quantize(milli, ROUND_HALF_UP)) if math.isfinite(x) else x

    def lots_of(x: float) -> int:
        return math.floor(x) * 100 if math.isfinite(x) else 0

    def walked(p: dict[str, Any], state: dict[str, Any], runs: list[tuple[int, int, bool]], bars: dict[str, list], entries: dict[int, tuple]) -> tuple[list, list, list]:
        """(bar, cash, risk) where they change in a batch, and (bar, position) and (bar, trade) where there is one; ``state`` is moved on.

        A flat account stays as it is up to its next candidate, so bars in between are passed over.
        """
        changes, held, trades = [], [], []
        h, cash, peak, broken, losses, pause = (state[k] for k in ("h", "cash", "peak", "broken", "losses", "pause"))
        hold, activation, trail_pct, breakeven, fees = p["max_holding_days"], p["trail_activation"], p["trail_pct"], p["breakeven_pct"], p["fees"]
        index, highs, lows, prices, downs, lasts = bars.values()
        places = sorted(entries)

        def close(raw: float, reason: str) -> float:
            """Puts down the trade and gives its net price."""
            net = settle(raw - raw * fees)
            i, kind, pct, cash_in, adds, entry, _, _, quantity, _, _ = h
            trades.append((n, i, kind, pct, entry, quantity, adds, cash_in, cash + quantity * net, at, raw, net, reason))
            return net

        for lo, hi, begins in runs:
            if begins:
                h, cash, peak, broken, losses, pause = None, capital, capital, False, 0, 0
            changes.append((lo, cash, peak, broken, losses, pause))
            n, ahead, end = lo, bisect.bisect_left(places, lo), bisect.bisect_left(places, hi)
            while n < hi:
                if h is None and not pause:
                    while ahead < end and places[ahead] < n:
                        ahead += 1
                    if ahead == end or broken:
                        break
                    n = places[ahead]
                at, price = index[n], prices[n]
                if h is not None and downs[n] is False and at - h[0] >= min_hold:
                    i, kind, pct, cash_in, adds, entry, stop, target, quantity, top, trails = h
                    high, low = highs[n], lows[n]
                    profit = (price - entry) / entry
                    top, trails = high if high > top else top, trails or profit >= activation
                    trail = top * (1 - trail_pct)
                    if low <= stop:
                        out = stop, "stop_loss"
                    elif at - i >= hold:
                        out = price, "time_exit"
                    elif trails and low <= trail:
                        out = trail, "trailing_stop"
                    elif price >= target:
                        out = price, "target_reached"
                    else:
                        out = None
                        h = (i, kind, pct, cash_in, adds, entry, entry if profit >= breakeven and stop < entry else stop, target, quantity, top, trails)
                    if out is not None:
                        net = close(*out)
                        cash, h = cash + quantity * net, None
                        if rules:
                            losses = losses + 1 if net < entry else 0
                            pause = rules["pause"] if net < entry and losses >= rules["losses"] else pause
                if h is None and n in entries and not (rules and (broken or pause)):
                    entry, stop, target, pct, kind = entries[n]
                    lots = lots_of(cash * pct / entry / 100)
                    if lots >= 100 and lots * entry <= cash:
                        cash -= lots * entry
                        h = (at, kind, pct, cash, 0, entry, stop, target, lots, entry, False)
                if rules:
                    value = h[8] * price if h is not None else 0.0
                    total = cash + (value if value == value else 0.0)
                    peak = max(peak, total)
                    broken = broken or (peak - total) / peak >= rules["break_drawdown"]
                    pause = max(pause - 1, 0)
                    if h is not None and not broken and not pause and h[4] < rules["most_adds"] and (price - h[5]) / h[5] >= rules["add_gain"]:
                        cost = price * (1 + p["commission"] + p["slippage"])
                        lots = lots_of(max(h[8] * h[5] * rules["add_share"], price * 110) / cost / 100)
                        if lots >= 100 and lots * cost <= cash:
                            average = (h[8] * h[5] + lots * cost) / (h[8] + lots)
                            cash -= lots * cost
                            h = (*h[:4], h[4] + 1, settle(average), settle(average * (1 - p["min_stop_pct"])), h[7], h[8] + lots, *h[9:])
                changes.append((n, cash, peak, broken, losses, pause))
                if h is not None:
                    held.append((n, h))
                    if lasts[n]:
                        close(price, "end_of_backtest")
                n += 1
        state.update(h=h, cash=cash, peak=peak, broken=broken, losses=losses, pause=pause)
        return changes, held, trades

    def column(values: Any, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind, from_pandas=pa.types.is_floating(kind))

    def packed(rows: list[tuple], fields: list[pa.Field]) -> pa.StructArray:
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.StructArray.from_arrays([column(c, f.type) for c, f in zip(columns, fields)], fields=fields)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, ended = [dict.fromkeys(("h", "cash", "peak", "broken", "losses", "pause")) for _ in plain], True
        for batch in checked(batches):
            size = batch.num_rows
            if not size:
                continue
            numbers = lambda column: pc.fill_null(column, math.nan).to_numpy(zero_copy_only=False).tolist()
            listed = lambda column: column.to_numpy(zero_copy_only=False).tolist()
            bars = {"i": listed(batch["i"])} | {c: numbers(batch[c]) for c in ("high", "low", "close")} | {c: listed(batch[c]) for c in ("limit_down", "last")}
            edges = [0, *(np.flatnonzero(bars["last"][:-1]) + 1).tolist(), size]
            runs = [(lo, hi, ended or lo > 0) for lo, hi in zip(edges, edges[1:])]
            ended = bars["last"][-1]
            for k, p in enumerate(plain):
                where = np.flatnonzero(batch[f"c{k}"].is_valid().to_numpy(zero_copy_only=False))
                found = batch[f"c{k}"].take(pa.array(where))
                read = [*[numbers(found.field(c)) for c in ("entry", "stop", "target", "position_pct")], found.field("signal_type").to_pylist()]
                changes, held, trades = walked(p, states[k], runs, bars, dict(zip(where.tolist(), zip(*read))))
                on = np.array([t[0] for t in trades], dtype=np.int64)
                rows = np.arange(size) if every else np.unique(on)
                if not len(rows):
                    continue
                # The last change at or before each row.
                at_change = np.searchsorted(np.array([c[0] for c in changes]), rows, side="right") - 1
                now = lambda position, kind: column([c[position] for c in changes], kind).take(pa.array(at_change))
                at = np.full(size, -1)
                at[[n for n, _ in held]] = np.arange(len(held))
                at = at[rows]
                h = packed([x for _, x in held], held_fields).take(pa.array(at, mask=at < 0))
                dates = batch["date"].take(pa.array(on)).to_pylist()
                done = packed([(*t[1:10], day, *t[10:]) for t, day in zip(trades, dates)], trade_fields)
                ends = np.concatenate([[0], np.cumsum(np.bincount(on, minlength=size)[rows])]).astype(np.int32)
                own = batch.select(["symbol", "date", "i", "close"]) if every else batch.select(["symbol", "date", "i", "close"]).take(pa.array(rows))
                columns = {"style": pa.array([p["style"]]).take(pa.array(np.zeros(len(rows), np.int64)))} | dict(zip(own.schema.names, own.columns)) | {
                    "cash": now(1, pa.float64()), "h": h, "trades": pa.ListArray.from_arrays(pa.array(ends), done)}
                if rules:
                    columns |= {f.name: now(2 + n, f.type) for n, f in enumerate(risk_fields)}
                yield pa.RecordBatch.from_pydict(columns)

    return folded


def accounts(rows: DataFrame, presets: list[Preset] | None = None, capital: float = 100_000.0, risk: Risk | None = None, every: bool = True) -> DataFrame:
    """One account per symbol and preset that trades the candidates of ``candidate_rows``: its state after every bar.

    ``style, symbol, date, i, close, cash, h`` (the position, null when flat) and ``trades`` closed at that bar; what is open at a symbol's last bar is
    closed there as ``end_of_backtest``, after the bar's state. All presets are folded in one pass over a symbol's bars, in the task and the order of its frames.
    Without ``every``, only the states of bars at which a trade closes are given out, which is all that ``account_trades`` reads.
    """
    presets = presets or [BASE]
    inputs = in_series(rows).select("symbol", "date", "i", "high", "low", "close", "limit_down", "last", *[f"c{k}" for k in range(len(presets))])
    nested = lambda schema: "struct<" + ", ".join(c.replace(" ", ": ") for c in schema.split(", ")) + ">"
    out = f"style string, symbol string, date date, i bigint, close double, cash double, h {nested(POSITION)}, trades array<{nested(TRADE)}>" + (f", {RISK_STATE}" if risk else "")
    return inputs.mapInArrow(account_fold(presets, capital, risk, "last" in rows.columns, every), out)


def account_trades(states: DataFrame) -> DataFrame:
    """The trades of ``accounts``, one row each, with their results."""
    return with_results(states.where(F.size("trades") > 0).select("style", "symbol", F.inline("trades")))


def account_curve(states: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Cash, position value and total of each account at each bar from the warm-up on."""
    held = F.coalesce(F.col("h.quantity") * F.col("close"), F.lit(0.0))
    return states.where(F.col("i") >= WARM_UP).select(
        "style", "symbol", "date", "i", F.round("cash", 2).alias("capital"), F.round(held, 2).alias("position_val"), F.round(F.col("cash") + held, 2).alias("total"),
        F.round(((F.col("cash") + held) / capital - 1) * 100, 3).alias("return_pct"))


def equity(trades: DataFrame, bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Cash, position value and total of each symbol's account at each bar from the warm-up on; closes at the end of data come after the last point."""
    rows = bars.select("symbol", "date", "close", (row_no() - 1).cast("long").alias("i")).where(F.col("i") >= WARM_UP)
    opened = trades.select("symbol", F.col("i").alias("i"), F.struct(F.lit(1).alias("kind"), F.col("cash_in").alias("cash"), F.col("quantity").alias("held")).alias("e"))
    closed = trades.where("exit_reason <> 'end_of_backtest'").select("symbol", F.col("exit_i").alias("i"), F.struct(F.lit(0).alias("kind"), F.col("cash_out").alias("cash"), F.lit(0).cast("long").alias("held")).alias("e"))
    events = opened.unionByName(closed).groupBy("symbol", "i").agg(F.max("e").alias("e"))
    now = F.last("e", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("i"))
    c = rows.join(events, ["symbol", "i"], "left").withColumn("now", now)
    cash, held = F.coalesce("now.cash", F.lit(capital)), F.coalesce("now.held", F.lit(0))
    return c.select(
        "symbol", "date", "i", F.round(cash, 2).alias("capital"), F.round(held * F.col("close"), 2).alias("position_val"), F.round(cash + held * F.col("close"), 2).alias("total"),
        F.round(((cash + held * F.col("close")) / capital - 1) * 100, 3).alias("return_pct"))


def pyramid_adds(entries: DataFrame, bars: DataFrame, gain: float = 0.05, max_hold: int = 20) -> DataFrame:
    """The first bar of each entry's path with a profit of ``gain`` or more: a candidate to add to the position."""
    rows = bars.select("symbol", F.col("date").alias("add_date"), F.col("close").alias("add_price"), (row_no() - 1).cast("long").alias("j"))
    path = entries.select("symbol", "i", "entry", F.explode(F.sequence(F.col("i") + 1, F.col("i") + max_hold)).alias("j")).join(rows, ["symbol", "j"])
    found = path.where((F.col("add_price") - F.col("entry")) / F.col("entry") >= gain)
    first = found.groupBy("symbol", "i").agg(F.min(F.struct("j", "add_date", "add_price")).alias("x"), F.first("entry").alias("entry"))
    return first.select("symbol", "i", F.col("x.j").alias("add_i"), F.col("x.add_date").alias("add_date"), F.col("x.add_price").alias("add_price"), ((F.col("entry") * 2 + F.col("x.add_price")) / 3).alias("average"))


def breaker(curve: DataFrame, limit_pct: float = 8.0) -> DataFrame:
    """Drawdown of each equity point and a flag that stays once the drawdown has reached the limit."""
    peak = F.max("total").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    c = curve.select("symbol", "date", "total", ((peak - F.col("total")) / peak * 100).alias("drawdown"))
    return c.withColumn("broken", F.max(F.col("drawdown") >= limit_pct).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))


def loss_streaks(trades: DataFrame, order: str = "exit_i", key: str = "symbol") -> DataFrame:
    """Length of the losing streak that ends with each trade."""
    w = Window.partitionBy(key).orderBy(order, "i").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("won", (F.col("pnl") > 0).cast("int")).withColumn("island", F.sum("won").over(w))
    within = Window.partitionBy(key, "island").orderBy(order, "i").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("streak", F.sum(1 - F.col("won")).over(within)).drop("won", "island")


def cooldowns(trades: DataFrame, losses: int = 3, days: int = 3) -> DataFrame:
    """Bars on which entries are blocked: the exit bar of a ``losses``-th loss in a row and the next ``days - 1``."""
    hit = loss_streaks(trades).where(F.col("streak") >= losses)
    return hit.select("symbol", F.explode(F.sequence(F.col("exit_i"), F.col("exit_i") + days - 1)).alias("blocked_i")).distinct()
