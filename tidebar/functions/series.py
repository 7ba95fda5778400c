"""Trailing frames and ordered folds over one series per symbol.

All frames use the same partitioning and order, so Spark plans one shuffle and one sort for any number of them.
Strict frames are null until they are full; nothing here returns NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def row_no() -> Column:
    return F.row_number().over(by_date())


def frame(lo: int, hi: int = 0):
    return by_date().rowsBetween(lo, hi)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_date())


def strict(value: Column, rows: int) -> Column:
    """``value`` from row number ``rows`` on, null before."""
    return F.when(row_no() >= rows, value)


def mean_rows(c: str | Column, lo: int, hi: int = 0) -> Column:
    return strict(F.avg(c).over(frame(lo, hi)), 1 - lo)


def with_means(df: DataFrame, frames: dict[str, tuple[str, int, int]], row: str = "rn") -> DataFrame:
    """Adds strict means ``name: (column, lo, hi)``. Spark evaluates a frame once for each time that it is written, so formulas should read these columns."""
    raw = df.withColumns({name: F.avg(c).over(frame(lo, hi)) for name, (c, lo, hi) in frames.items()})
    return raw.withColumns({name: F.when(F.col(row) >= 1 - lo, F.col(name)) for name, (_, lo, _) in frames.items()})


def max_rows(c: str | Column, lo: int, hi: int = 0) -> Column:
    return strict(F.max(c).over(frame(lo, hi)), 1 - lo)


def min_rows(c: str | Column, lo: int, hi: int = 0) -> Column:
    return strict(F.min(c).over(frame(lo, hi)), 1 - lo)


def change(c: str | Column, n: int = 1) -> Column:
    """Return over n rows; null where the old value is null or 0."""
    return F.col(c) / F.nullif(lag(c, n), F.lit(0.0)) - 1 if isinstance(c, str) else c / F.nullif(lag(c, n), F.lit(0.0)) - 1


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def scaled(x: Column, lo: float, hi: float) -> Column:
    """Clamped position of x between lo and hi."""
    return clamp((x - lo) / (hi - lo + 1e-12))


def settled(x: Column, places: int) -> Column:
    """Rounded with a nudge far below the last place, so that binary noise does not decide ties."""
    return F.round(x + 1e-9, places)


def rounded_at(x: Column, places: int) -> Column:
    """Rounded as SQL engines round a double: at the scaled value. Spark's own rounding goes by the shortest decimal text, which takes another side where the double is just below a half."""
    return F.round(x * 10.0**places) / 10.0**places


def signed_share(x: Column, scale: float) -> Column:
    return F.signum(x) * F.least(F.abs(x) / scale, F.lit(1.0))


#: A weight below this part of the newest one is lost in a double.
LOST = 1e-18


def with_ema(df: DataFrame, series: dict[str, tuple[Column, float, Column]]) -> DataFrame:
    """Adds exponential means ``name: (x, alpha, first)``: ``first`` at a symbol's first row, then ``alpha * x`` plus ``1 - alpha`` of the row before.

    A scan by doubling: the sum over ``n`` rows with weights q**age and the same sum ``n`` rows earlier, times q**n, make the sum over ``2 * n`` rows. It ends
    when the weight of an older row is lost in a double, so every value is a sum over a bounded number of rows (``ema_memory``) and no state is carried along.
    """
    df = df.withColumns({name: F.when(row_no() == 1, first).otherwise(x * alpha) for name, (x, alpha, first) in series.items()})
    n = 1
    while live := {name: (1 - alpha) ** n for name, (_, alpha, _) in series.items() if (1 - alpha) ** n >= LOST}:
        df = df.withColumns({name: F.col(name) + F.coalesce(lag(name, n), F.lit(0.0)) * weight for name, weight in live.items()})
        n *= 2
    return df


def ema_memory(alpha: float) -> int:
    """Rows that an exponential mean looks back on."""
    n = 1
    while (1 - alpha) ** n >= LOST:
        n *= 2
    return n


#: A frame of ``trailing``: what is computed, of which column, over which rows (of ``ema``: the weight, and nothing).
Trail = tuple[str, str, float, int]
#: Values and where they are null, None if nowhere.
Values = tuple[np.ndarray, np.ndarray | None]


def trailing(inputs: list[str], frames: dict[str, Trail], more: int = 0) -> Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[tuple[int, np.ndarray, dict[str, Values]]]]:
    """Many frames ``name: (kind, column, lo, hi)`` over batches of (row number, inputs) in order of symbol and date, rows numbered from 1 in each symbol.

    For each batch it gives a buffer: how many rows of it came before the batch, the row numbers, and the frames at every row. Only the rows that frames look back on are carried to
    the next batch, so values are right for the batch and ``more`` rows before it. Kinds are ``mean, sum, max, min, spread`` (the population's standard deviation) of rows ``lo`` to ``hi`` counted from the row itself, ``first``, ``lag``
    (``lo`` rows back), ``own`` (the row's value) and ``ema`` (``with_ema`` of weight ``lo`` over rescaled values). Spark walks a frame anew for each row; here a batch takes one vector operation for each row of the frame.
    Nulls are left out of sums, means and extremes as Spark does, and sums are taken from the oldest row on, so values are those of Spark's frames bit by bit.
    """
    lost = LOST

    def rounds(alpha: float) -> list[tuple[int, float]]:
        n, out = 1, []
        while (1 - alpha) ** n >= lost:
            out.append((n, (1 - alpha) ** n))
            n *= 2
        return out

    reach = [sum(n for n, _ in rounds(lo)) if kind == "ema" else int(-lo) for kind, _, lo, _ in frames.values()]
    most = max(reach, default=0) + more

    def computed(n: np.ndarray, x: dict[str, Values]) -> dict[str, Values]:
        """Values and nulls (None where there are none) of each frame at every row of a buffer."""
        size, here, out = len(n), np.arange(len(n)), {}
        known: dict[int, np.ndarray] = {}

        def held(k: int) -> np.ndarray:
            if k not in known:
                known[k] = n > k
            return known[k]

        def shifted(v: np.ndarray, k: int, fill: float) -> np.ndarray:
            """The value k rows before, ``fill`` where the symbol has no such row."""
            if k == 0:
                return v
            s = np.full(size, fill)
            s[k:] = v[: max(size - k, 0)]
            return np.where(held(k), s, fill)

        def rows_of(valid: np.ndarray | None, lo: int, hi: int) -> np.ndarray:
            """Rows that are not null in each frame."""
            if valid is None:
                return np.clip(np.minimum(n + hi, hi - lo + 1), 0, None)
            before = np.concatenate([[0], np.cumsum(valid)])
            first, end = np.clip(here + np.maximum(lo, 1 - n), 0, None), np.clip(here + hi + 1, 0, None)
            return np.where(end > first, before[end] - before[np.minimum(first, end)], 0)

        filled = {}

        def plain(c: str, fill: float) -> np.ndarray:
            """A column with its nulls as ``fill``."""
            v, null = x[c]
            if null is None:
                return v
            if (c, fill) not in filled:
                filled[c, fill] = np.where(null, fill, v)
            return filled[c, fill]

        sums: dict[str, list[tuple[str, int, int]]] = {}
        for name, (kind, c, lo, hi) in frames.items():
            if kind in ("mean", "sum"):
                sums.setdefault(c, []).append((name, int(lo), hi))
        for c, wanted in sums.items():
            v, null = plain(c, 0.0), x[c][1]
            totals = {name: np.zeros(size) for name, _, _ in wanted}
            for k in range(max(-lo for _, lo, _ in wanted), min(-hi for _, _, hi in wanted) - 1, -1):
                now = [name for name, lo, hi in wanted if -hi <= k <= -lo]
                if now:
                    s = shifted(v, k, 0.0)
                    for name in now:
                        totals[name] += s
            for name, lo, hi in wanted:
                rows = rows_of(None if null is None else ~null, lo, hi)
                none = rows == 0
                out[name] = totals[name] / np.where(none, 1, rows) if frames[name][0] == "mean" else totals[name], none
        for name, (kind, c, lo, hi) in frames.items():
            null = x[c][1]
            valid = None if null is None else ~null
            if kind in ("max", "min"):
                fill, better = (-np.inf, np.maximum) if kind == "max" else (np.inf, np.fmin)
                v, best = plain(c, fill), np.full(size, fill)
                for k in range(int(-lo), -hi - 1, -1):
                    best = better(best, shifted(v, k, fill))
                out[name] = best, rows_of(valid, int(lo), hi) == 0
            elif kind in ("lag", "first"):
                steps = np.minimum(int(-lo), n - 1) if kind == "first" else np.full(size, int(-lo))
                at = np.clip(here - steps, 0, None)
                out[name] = x[c][0][at], (n <= steps) if null is None else (n <= steps) | null[at]
            elif kind == "spread":
                v, count, mean, m2 = plain(c, 0.0), np.zeros(size), np.zeros(size), np.zeros(size)
                for k in range(int(-lo), -hi - 1, -1):
                    ok = held(k) if valid is None else held(k) & (shifted(valid.astype(float), k, 0.0) > 0)
                    s = shifted(v, k, 0.0)
                    delta = np.where(ok, s - mean, 0.0)
                    count = count + ok
                    part = delta / np.where(ok, count, 1.0)
                    mean = mean + part
                    m2 = m2 + delta * (delta - part)
                out[name] = np.sqrt(m2 / np.where(count == 0, 1.0, count)), count == 0
            elif kind == "ema":
                v = plain(c, 0.0)
                for k, weight in rounds(lo):
                    v = v + shifted(v, k, 0.0) * weight
                    v = v if null is None else np.where(null, 0.0, v)
                out[name] = v, null
            elif kind == "own":
                out[name] = x[c]
        return out

    def read(column: pa.Array) -> Values:
        null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
        v = column.to_numpy(zero_copy_only=False).astype(np.float64)
        return v if null is None else np.where(null, 0.0, v), null

    def walked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[int, np.ndarray, dict[str, Values]]]:
        old_n, old = np.zeros(0, np.int64), {}
        for number, *columns in batches:
            kept, size = len(old_n), len(number)
            n, x = np.concatenate([old_n, number.to_numpy(zero_copy_only=False).astype(np.int64)]), {}
            for c, (v, null) in zip(inputs, map(read, columns)):
                v0, null0 = old.get(c, (np.zeros(0), None))
                nulls = None if null is None and null0 is None else np.concatenate([np.zeros(kept, bool) if null0 is None else null0, np.zeros(size, bool) if null is None else null])
                x[c] = np.concatenate([v0, v]), nulls
            yield kept, n, computed(n, x)
            if size:
                stay = min(int(n[-1]), most, len(n))
                old_n, old = n[len(n) - stay :], {c: (v[len(n) - stay :], None if null is None else null[len(n) - stay :]) for c, (v, null) in x.items()}

    return walked


def by_segments(bars: DataFrame, op: Callable[[DataFrame], DataFrame], memory: int, bucket: Column, rows: int = 65_536) -> DataFrame:
    """``op`` over segments of each symbol's series, so that one long series is the work of many tasks.

    ``op`` maps bars to rows with ``symbol, date`` and looks back at most ``memory`` rows; each segment of ``rows`` rows gets that many rows in front,
    whose results are dropped. Rows are numbered without a pass over a whole symbol: within ``bucket`` (any expression that rises with the date, a year say), plus
    the counts of the buckets before.
    """
    rows = max(rows, memory)
    sized = bars.withColumn("__bucket", bucket)
    counts = sized.groupBy("symbol", "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("symbol").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("symbol", "__bucket").orderBy("date")) - 1
    placed = sized.withColumn("__at", place).join(counts.select("symbol", "__bucket", before.alias("__before")), ["symbol", "__bucket"]).withColumn("__at", F.col("__at") + F.col("__before"))
    own = F.floor(F.col("__at") / rows)
    both = F.when(F.col("__at") % rows >= rows - memory, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("__own", own).withColumn("__segment", F.explode(both))
    # A segment stands for a symbol of its own; which rows are its own is looked up by the date where it begins.
    key = F.concat_ws("#", F.col("__segment"), F.col("symbol"))
    starts = spread.where("__segment = __own").groupBy(key.alias("symbol")).agg(F.min("date").alias("__from"))
    out = op(spread.withColumn("symbol", key).select(*bars.columns))
    return out.join(starts, "symbol").where(F.col("date") >= F.col("__from")).withColumn("symbol", F.expr("substring(symbol, instr(symbol, '#') + 1)")).drop("__from")


BLOCK = 64  # bars that are folded as one array


def fold_series(bars: DataFrame, inputs: list[str], begin: Callable[[Column], Column], step: Callable[[Column, Column], Column]) -> DataFrame:
    """Ordered fold per symbol: ``symbol, date`` and the state after each bar.

    ``begin`` makes the first state from the first bar, ``step`` the next one from a state and a bar; a step from the
    first state over the first bar is left out. Spark copies what a fold has gathered at every step, so the fold runs
    twice over blocks: once to carry the state from block to block, once inside each block from its carried state.
    Time is in proportion to the bars of a symbol, and the arithmetic is that of one fold. Symbols are the unit of distribution.
    """
    chunk = bars.withColumn("block", F.floor((row_no() - 1) / BLOCK)).groupBy("symbol", "block").agg(F.sort_array(F.collect_list(F.struct("date", *inputs))).alias("s"))
    series = chunk.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "s"))).alias("blocks"))
    first = begin(F.col("blocks")[0]["s"][0])
    rest = lambda x: F.when(x["block"] == 0, F.slice(x["s"], 2, BLOCK)).otherwise(x["s"])
    starts = F.aggregate("blocks", F.array(first), lambda had, x: F.array_append(had, F.aggregate(rest(x), F.element_at(had, -1), step)))
    each = series.select("symbol", F.inline(F.zip_with("blocks", F.slice(starts, 1, F.size("blocks")), lambda x, start: F.struct(x["block"].alias("block"), x["s"].alias("s"), start.alias("start")))))
    here = F.struct("block", "s")
    states = F.aggregate(rest(here), F.array("start"), lambda had, x: F.array_append(had, step(F.element_at(had, -1), x)))
    own = F.when(F.col("block") == 0, states).otherwise(F.slice(states, 2, BLOCK))  # a later block begins with the state before it
    pairs = F.arrays_zip(F.transform("s", lambda x: x["date"]).alias("date"), own.alias("state"))
    return each.select("symbol", F.inline(pairs)).select("symbol", "date", "state.*")
