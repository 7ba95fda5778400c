"""Possible entries at every bar: regime, score and signal of ``regime``, ``factors`` and ``strategy`` as vector operations over Arrow batches, in one pass over sorted bars.

Nulls are NaN here: NaN passes no test, ``fmin`` and ``fmax`` leave it out as Spark's ``least`` and ``greatest`` do with nulls. Formulas are written in the order of the operators' ones, so that values are equal bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Trail, by_date, frame, lag, row_no, trailing
from . import detectors, factors, indicators, regime
from .strategy import BOOST, MIN_SERIES, Preset

CANDIDATE = "entry: double, stop: double, target: double, position_pct: double, signal_type: string, confidence: double"
#: Frames of regime and score, read at the last grid bar; the mean of 120 closes is a frame of the bars already.
AT_GRID: dict[str, Trail] = {
    **{f"r_{name}": ("mean", *spec) for name, spec in regime.MEANS.items() if name != "m120"}, **{f"f_{name}": ("mean", *spec) for name, spec in factors.MEANS.items() if name not in factors.SHARED},
    **{f"c{n}": ("lag", "close", -n, 0) for n in (5, 19, 20, 60)}, **{name: ("own", name, 0, 0) for name in ("close", "volume", "m120")}, "c_first": ("first", "close", -19, 0),
    "spread": ("spread", "day_ret", -28, 0), "with_volume": ("sum", "signed", -9, 0), "gain": ("ema", "gain", indicators.WILDER, 0), "loss": ("ema", "loss", indicators.WILDER, 0),
}


def price_trails(lookbacks: list[int]) -> dict[str, Trail]:
    """``strategy.price_frames`` of the bar before, and whether the bar itself is at its limit."""
    highs = {f"prev_high_{n}": ("max", "high", -n - 1, -2) for n in lookbacks}
    return {
        "before": ("lag", "close", -1, 0), "before6": ("lag", "close", -6, 0), "atr": ("mean", "tr", -14, -1), "low5": ("min", "low", -5, -1), "high60": ("max", "high", -61, -2),
        "v5": ("mean", "volume", -5, -1), "v15": ("mean", "volume", -20, -6), "v20": ("mean", "volume", -20, -1), "limit_up": ("own", "limit_up", 0, 0), **highs}


def with_entries(bars: DataFrame, presets: list[Preset], grid: int, warm_up: int, limit: Column | None = None) -> DataFrame:
    """The bars (``symbol, date, i, high, low, close, limit_down, last``) in order of symbol and date, a symbol's in one task, with the possible entry of each preset in ``c0, c1, ...``.

    One window numbers the bars and reads the day before; one pass over batches computes all other frames, regime and score at grid bars, and the signals of bars that pass the gates.
    """
    b = bars.withColumns({
        "rn": row_no(), "c1": lag("close"), "v1": lag("volume"), "last": F.lead("date").over(by_date()).isNull(), "m120": F.avg("close").over(frame(-119))}).sortWithinPartitions("symbol", "date")
    c, prev, zero = F.col("close"), F.col("c1"), F.lit(0.0)
    d = F.coalesce(c - prev, zero)
    b = b.select(
        "symbol", "date", "rn", "last", "high", "low", "close", "volume", "m120", *detectors.flags(limit, prev), ((c - prev) / (prev + 1e-8)).alias("day_ret"), indicators.true_range(prev).alias("tr"),
        F.when(F.col("volume") - F.col("v1") > 0, F.signum(d)).otherwise(0.0).alias("signed"),
        *[F.when(F.col("rn") == 1, zero).otherwise(F.greatest(x, zero) * indicators.WILDER).alias(name) for name, x in (("gain", d), ("loss", -d))])
    frames = {**price_trails(sorted({p.target_lookback for p in presets})), **{f"g_{name}": spec for name, spec in AT_GRID.items()}}
    inputs = list(dict.fromkeys(column for _, column, _, _ in frames.values()))
    fold = entry_fold(presets, inputs, frames, grid, warm_up)

    def entries(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from fold(batches)

    out = "struct<" + ", ".join(f"c{k}: struct<{CANDIDATE}>" for k in range(len(presets))) + ">"
    found = F.arrow_udf(entries, out).asNondeterministic()(F.col("rn"), *[F.col(name).cast("double") for name in inputs])
    return b.withColumn("found", found).select("symbol", "date", (F.col("rn") - 1).cast("long").alias("i"), "high", "low", "close", "limit_down", "last", "found.*")


def entry_fold(presets: list[Preset], inputs: list[str], frames: dict[str, Trail], grid: int, warm_up: int):
    """Batches of (row number, inputs) to a struct with the candidate of each preset, null where there is none."""
    fold, plain = trailing(inputs, frames, grid), [asdict(p) for p in presets]
    strict = {f"g_{name}": 1 - spec[2] for name, spec in AT_GRID.items() if spec[0] == "mean"} | {"g_m120": 120}
    back = [name for name in frames if name.startswith("g_")]
    names = list(regime.MAX_POSITION)
    position, positions, boost = (np.array([float(table[name]) for name in names]) for table in (regime.MAX_POSITION, regime.MAX_POSITIONS, BOOST))
    at_rest, risky, bottom, bull, game = (names.index(name) for name in ("structural", "systemic_risk", "policy_bottom", "bull_trend", "stock_game"))
    shared, min_rows, regime_rows, min_series = factors.SHARED, factors.MIN_ROWS, regime.MIN_ROWS, MIN_SERIES
    min_volume, below_cost, oversold, weights = factors.MIN_VOLUME, factors.BELOW_COST, factors.OVERSOLD, factors.WEIGHTS
    kinds = ["volume_surge", "momentum_breakout", "pullback_entry", "trend_continuation"]
    fields = [pa.field("entry", pa.float64()), pa.field("stop", pa.float64()), pa.field("target", pa.float64()), pa.field("position_pct", pa.float64()), pa.field("signal_type", pa.string()), pa.field("confidence", pa.float64())]

    def clamp(x, lo=0.0, hi=1.0):
        return np.fmin(hi, np.fmax(lo, x))

    def over(a, b):
        """A quotient, null where the divisor is 0."""
        return a / np.where(b == 0, np.nan, b)

    def above(a, b):
        return np.where(np.isnan(a) | np.isnan(b), np.nan, a > b)

    def settled(x, places):
        """``settled``: halves of the shortest decimal text go up; only values very near a half are looked at as text."""
        y, scale = x + 1e-9, 10.0**places
        size = np.abs(y) * scale
        whole = np.floor(size)
        out = np.copysign((whole + (size - whole >= 0.5)) / scale, y)
        for k in np.flatnonzero(np.abs(size - whole - 0.5) < 1e-7):
            out[k] = float(Decimal(repr(float(y[k]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
        return np.where(np.isfinite(y), out, y)

    def regimes(rn, g):
        """``regime.classify``: number of the regime, greatest position and number of positions."""
        c, m20, m60, m120, now, base, before = (g[name] for name in ("close", "r_m20", "r_m60", "m120", "r_v_now", "r_v_base", "r_v_before"))
        held = 0.30 * (c > m20) + 0.25 * (c > m60) + 0.20 * (c > m120) + 0.25 * ((m20 > m60) & (m60 > m120))
        slope = (c - g["c19"]) / (g["c19"] + 1e-8)
        t = clamp(held + np.where(slope > 0.05, 0.1, np.where(slope < -0.05, -0.1, 0.0)))
        ratio = now / (base + 1e-8)
        level = np.where(ratio >= 1.5, np.fmin(1.0, 0.5 + 0.5 * np.fmin(ratio - 1, 1.0)), np.where(ratio <= 0.7, np.fmax(0.0, 0.5 * ratio / 0.7), 0.5 + (ratio - 1) * 0.5 / 0.5))
        rise = (now - before) / (before + 1e-8)
        moved = np.where(rise > 0.1, np.fmin(1.0, level + 0.05), np.where(rise < -0.1, np.fmax(0.0, level - 0.05), level))
        v = np.where(rn >= 30, moved, 0.5)
        share = lambda x, scale: np.sign(x) * np.fmin(np.abs(x) / scale, 1.0)
        m = clamp(0.5 + 0.20 * share(g["past5"], 0.05) + 0.30 * share(g["past20"], 0.10) + 0.20 * share(g["past60"], 0.20))
        ret = over(c, np.where(np.isnan(g["c19"]), g["c_first"], g["c19"])) - 1
        r = np.where(ret < -0.08, 0.1, np.where(ret > 0.15, 0.8, clamp(0.7 - np.where(rn >= 31, g["spread"] * (252**0.5), 0.0) * 0.5, 0.1, 0.9)))
        is_bottom, is_bull, is_game = (t < 0.25) & (v > 0.65) & (m > 0.35) & (r > 0.5), (t > 0.70) & (v > 0.60) & (m > 0.65), (v < 0.35) & (t < 0.55)
        short = rn < regime_rows
        kind = np.select([short, r < 0.15, is_bottom, is_bull, is_game], [at_rest, risky, bottom, bull, game], at_rest)
        return kind, np.where(short, 0.30, position[kind]), np.where(short, 2.0, positions[kind])

    def scores(rn, g):
        """``factors.score``: the total, and whether no filter failed."""
        f = lambda name: g["m120" if name == "ma120" else f"r_{shared[name]}" if name in shared else f"f_{name}"]
        c, m5, m20, m60, cost_line = (g["close"], *map(f, ("m5", "m20", "m60", "ma120")))
        scaled = lambda x, lo, hi: clamp((x - lo) / (hi - lo + 1e-12))
        ratio = f("v10") / (f("v10_before") + 1e-8)
        support = np.where(rn >= 20, clamp(0.5 + (ratio - 1) * 0.5), 0.5)
        base = 0.25 * scaled(g["past5"], -0.08, 0.08) + 0.45 * scaled(g["past20"], -0.15, 0.15) + 0.30 * scaled(g["past60"], -0.30, 0.30)
        momentum = clamp(base + np.where(support > 0.6, 0.05, np.where(support < 0.4, -0.05, 0.0)))
        level = np.where((ratio >= 1.2) & (ratio <= 2.5), np.fmin(1.0, 0.5 + (ratio - 1.2) / 2.6), np.where(ratio > 2.5, np.fmax(0.3, 1 - (ratio - 2.5) * 0.15), np.fmax(0.0, ratio / 1.2 * 0.5)))
        turnover = np.where(rn >= 20, np.where(f("v5") > f("v5_before") * 1.05, np.fmin(1.0, level + 0.1), level), 0.5)
        line = 0.25 * above(c, m5) + 0.25 * above(m5, m20) + 0.20 * above(m20, m60) + 0.15 * above(c, m20) + 0.15 * above(c, m60)
        away = (c - m20) / (m20 + 1e-8)
        trend = np.where(rn >= 120, np.where((away >= 0.02) & (away <= 0.08), np.fmin(1.0, line + 0.05), line), 0.5)
        x = np.where(rn == 1, 50.0, 100 - 100 / (1 + g["gain"] / (g["loss"] + 1e-10)))
        rsi = np.select(
            [(x >= 50) & (x <= 65), (x >= 45) & (x < 50), (x > 65) & (x <= 72), (x >= 40) & (x < 45), (x > 72) & (x <= 80), x > 80], [1.0, 0.85, 0.75, 0.60, 0.50, 0.20], 0.35)
        vol_price = np.where(rn >= 11, clamp(0.5 + 0.5 * g["with_volume"] / 10), 0.5)
        off = (c - cost_line) / (cost_line + 1e-8)
        band = np.select([(off >= 0.05) & (off <= 0.20), (off > 0.20) & (off <= 0.35), off > 0.35, (off >= 0) & (off < 0.05), (off >= -0.05) & (off < 0)], [1.0, 0.70, 0.30, 0.85, 0.60], 0.20)
        parts = {"momentum": momentum, "turnover": turnover, "trend": trend, "rsi": rsi, "vol_price": vol_price, "cost": np.where(rn >= 120, band, 0.5)}
        total = sum((parts[name] * w for name, w in weights.items()), 0.0) * 100.0
        whole = np.floor(total)
        failed = (rn < min_rows) | (np.where(rn >= 20, f("v20"), g["volume"]) < min_volume) | (c < cost_line * (1 - below_cost)) | (x < oversold)
        return np.where(failed, 0.0, (whole + (total - whole >= 0.5)) / 100.0), ~failed

    def signals(p, x):
        """``strategy.with_signal`` of a preset: which rows are valid, and their candidates."""
        c, high, score, cap = x["before"], x[f"prev_high_{p['target_lookback']}"], x["score"], x["position"]
        raw = np.fmin(c - p["atr_stop_mult"] * x["atr"], x["low5"] * 0.99)
        stop = settled(np.fmin(np.fmax(raw, c * (1 - p["max_stop_pct"])), c * (1 - p["min_stop_pct"])), 3)
        far = np.fmax(x["high60"] * (1 - p["target_buffer"]), c * 1.08)
        aim = np.where(c >= high * 0.98, far, high * (1 - p["target_buffer"]))
        target = settled(np.where(aim <= c * 1.02, c * (1 + max(p["min_stop_pct"] * p["min_rr_ratio"], 0.05)), aim), 3)
        rr = (target - c) / (c - stop + 1e-8)
        r = over(c, x["before6"]) - 1
        vr, r = x["v5"] / (np.where(x["n"] > 20, x["v15"], x["v20"]) + 1e-8), np.where(np.isnan(r), 0.0, r)
        kind = np.select([(vr >= 1.8) & (r > 0.03), r > 0.04, (r >= -0.03) & (r <= 0.01)], [0, 1, 2], 3)
        sure = settled(clamp(0.45 + (score - p["min_factor_score"]) / 90 * 0.50 + boost[x["kind"]], 0.45, 0.95), 3)
        size = cap * (0.5 + sure * np.fmin(rr / 2, 1.0) * 0.5)
        pct = settled(np.fmin(np.fmin(size, p["base_position_pct"] * 2), cap / np.fmax(x["positions"], 1.0)), 4)
        entry = settled(c * (1 + p["commission"] + p["slippage"]), 3)
        made = (score >= p["min_factor_score"]) & (x["n"] - 1 >= min_series) & (rr >= p["min_rr_ratio"]) & (sure >= p["min_confidence"])
        sound = (stop < entry) & (entry < target) & ((target - entry) / (entry - stop + 1e-8) >= 1.3) & (sure >= 0.45)
        valid = np.flatnonzero(made & sound)
        columns = (entry, stop, target, pct, kind, sure)
        arrays = [pa.array(kinds).take(pa.array(v[valid])) if v is kind else pa.array(v[valid], pa.float64(), from_pandas=True) for v in columns]
        return valid, pa.StructArray.from_arrays(arrays, fields=fields)

    def numbers(values, at):
        v, null = values
        return v[at] if null is None else np.where(null[at], np.nan, v[at])

    def folded(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for kept, n, out in fold(batches):
            size = len(n) - kept
            at = np.flatnonzero(n % grid == 0)
            rn, g = n[at], {name[2:]: numbers(out[name], at) for name in back}
            for name, rows in strict.items():
                g[name[2:]] = np.where(rn >= rows, g[name[2:]], np.nan)
            with np.errstate(all="ignore"):
                for k in (5, 20, 60):
                    past = over(g["close"], g[f"c{k}"]) - 1
                    g[f"past{k}"] = np.where(np.isnan(past), 0.0, past)
                kind, most, count = regimes(rn, g)
                score, passed = scores(rn, g)
            spread = {}
            for name, v in (("score", score), ("kind", kind), ("position", most), ("positions", count), ("open", passed & (kind != risky))):
                spread[name] = np.zeros(len(n), v.dtype)
                spread[name][at] = v
            here = np.arange(kept, len(n))
            steps = (n[here] - 1) % grid + 1
            read = np.clip(here - steps, 0, None)
            low = min(p["min_factor_score"] for p in plain)
            up = numbers(out["limit_up"], here) > 0
            rows = np.flatnonzero((n[here] > max(warm_up, grid)) & ~up & spread["open"][read] & (spread["score"][read] >= low))
            x = {name: numbers(out[name], here[rows]) for name in frames if name not in back}
            x |= {name: v[read[rows]] for name, v in spread.items()} | {"n": n[here[rows]]}
            arrays = []
            for p in plain:
                with np.errstate(all="ignore"):
                    valid, found = signals(p, x)
                place = np.full(size, -1)
                place[rows[valid]] = np.arange(len(valid))
                arrays.append(found.take(pa.array(place, mask=place < 0)))
            yield pa.StructArray.from_arrays(arrays, [f"c{k}" for k in range(len(plain))])

    return folded
