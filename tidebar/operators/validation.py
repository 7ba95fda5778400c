"""Walk-forward validation of strategies as set operations over windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import row_no, settled

TRAIN, VALID, STEP = 200, 130, 50


def walk_windows(bars: DataFrame, train: int = TRAIN, valid: int = VALID, step: int = STEP) -> DataFrame:
    """(symbol, w, row ranges) of every window that fits; indices are 0-based and ends exclusive."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= train + valid)
    w = n.select("symbol", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - valid) / step).cast("int"))).alias("w"))
    lo = (F.col("w") * step).cast("long")
    return w.select("symbol", F.col("w").cast("long").alias("w"), lo.alias("train_from"), (lo + train).alias("train_to"), (lo + train).alias("valid_from"), (lo + train + valid).alias("valid_to"))


def in_windows(rows: DataFrame, windows: DataFrame, train: int, valid: int, step: int) -> DataFrame:
    """``rows`` (symbol, i, ...) once for every window part that holds them: adds ``w`` and ``part``.

    Windows begin at multiples of ``step``, so the numbers of those around a row follow from its index; an equi-join then keeps those that the symbol has.
    """
    def around(part: str, start: int, length: int) -> Column:
        lo, hi = F.greatest(F.lit(0), F.ceil((F.col("i") - start - length + 1) / step)).cast("int"), F.floor((F.col("i") - start) / step).cast("int")
        none = F.array().cast("array<struct<part:string,w:bigint>>")
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda w: F.struct(F.lit(part).alias("part"), w.cast("long").alias("w")))).otherwise(none)

    spread = rows.withColumn("at", F.explode(F.concat(around("in", 0, train), around("out", train, valid)))).select(*rows.columns, "at.part", "at.w")
    return spread.join(windows.select("symbol", "w"), ["symbol", "w"])


def slice_fold(train: int, valid: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (symbol, i, total) in order to return, mean and deviation of the changes within each part of each window that has rows, whether the symbol has that window or not.

    Rows from the first slice that may still grow are carried to the next batch.
    """
    parts = [("in", 0, train), ("out", train, valid)]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent, old_i, old_total = None, {}, np.zeros(0, np.int64), np.zeros(0)
        out: list[tuple] = []

        def slices(symbol: str | None, i: np.ndarray, total: np.ndarray, ended: bool) -> int:
            """Puts down the slices that are complete; the first index that later ones need."""
            needed, top = int(i[-1]) + 1, int(i[-1])
            with np.errstate(all="ignore"):
                r = total[1:] / np.where(total[:-1] == 0, np.nan, total[:-1]) - 1
            for part, start, length in parts:
                w = sent.get(part, max(0, -(-(int(i[0]) - start - length + 1) // step)))
                while (lo := w * step + start) <= top and (ended or lo + length - 1 <= top):
                    a, b = np.searchsorted(i, [lo, lo + length])
                    if b > a:
                        x = r[a : b - 1]
                        x = x[~np.isnan(x)]
                        mean = x.sum() / len(x) if len(x) else np.nan
                        out.append((symbol, w, part, total[b - 1] / total[a] - 1 if total[a] else np.nan, mean, (((x - mean) ** 2).sum() / (len(x) - 1)) ** 0.5 if len(x) > 1 else np.nan))
                    w += 1
                sent[part], needed = w, min(needed, w * step + start)
            return needed

        def packed() -> pa.RecordBatch:
            symbol, w, part, *values = zip(*out)
            out.clear()
            numbers = [pa.array(np.array(v, dtype=float), pa.float64(), from_pandas=True) for v in values]
            return pa.RecordBatch.from_arrays([pa.array(symbol, pa.string()), pa.array(w, pa.int64()), pa.array(part, pa.string()), *numbers], ["symbol", "w", "part", "ret", "mu", "sd"])

        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = batch["symbol"].dictionary_encode()
            names, codes = symbols.dictionary.to_pylist(), symbols.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            i, total = batch["i"].to_numpy(zero_copy_only=False), batch["total"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for lo, hi in zip(edges, edges[1:]):
                symbol = None if codes[lo] < 0 else names[codes[lo]]
                if len(old_i) and symbol != held:
                    slices(held, old_i, old_total, True)
                    old_i, old_total = old_i[:0], old_total[:0]
                sent = sent if symbol == held else {}
                held, old_i, old_total = symbol, np.concatenate([old_i, i[lo:hi]]), np.concatenate([old_total, total[lo:hi]])
            keep = np.searchsorted(old_i, slices(held, old_i, old_total, False))
            old_i, old_total = old_i[keep:], old_total[keep:]
            if out:
                yield packed()
        if len(old_i):
            slices(held, old_i, old_total, True)
            if out:
                yield packed()

    return folded


def slice_metrics(curve: DataFrame, train: int = TRAIN, valid: int = VALID, step: int = STEP) -> DataFrame:
    """Return, mean and deviation of the changes of (symbol, i, total) within each part of each window; no point is copied for the windows that hold it."""
    points = curve.select(F.col("symbol").cast("string").alias("symbol"), F.col("i").cast("long").alias("i"), F.col("total").cast("double").alias("total"))
    ordered = points.repartition("symbol").sortWithinPartitions("symbol", "i")
    return ordered.mapInArrow(slice_fold(train, valid, step), "symbol string, w bigint, part string, ret double, mu double, sd double")


def window_metrics(windows: DataFrame, trades: DataFrame, curve: DataFrame, train: int = TRAIN, valid: int = VALID, step: int = STEP) -> DataFrame:
    """Trades, win rate, return and Sharpe inside and outside the sample of each window of ``walk_windows`` (of the same sizes).

    Warm-up is read from the bars before a slice, so validation slices have trades.
    """
    slices = windows.select("symbol", "w", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("part"))
    eq = slice_metrics(curve, train, valid, step)
    t = in_windows(trades.select("symbol", "i", "pnl"), windows, train, valid, step).groupBy("symbol", "w", "part").agg(
        F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"))
    both = slices.join(eq, ["symbol", "w", "part"], "left").join(t, ["symbol", "w", "part"], "left")
    n = F.coalesce("trades", F.lit(0))
    sharpe = F.when((n > 0) & (F.col("sd") > 0), (F.col("mu") - 0.03 / 252) / F.col("sd") * (252**0.5)).otherwise(0.0)
    return both.select(
        "symbol", "w", "part", n.alias("trades"), settled(F.coalesce("win_rate", F.lit(0.0)), 6).alias("win_rate"), settled(F.coalesce(F.col("ret") * 100, F.lit(0.0)), 6).alias("ret_pct"), settled(sharpe, 6).alias("sharpe"))


def split_sample(bars: DataFrame, out_share: float = 0.3) -> DataFrame:
    """Marks each bar as in or out of the sample, by row count."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return bars.select("symbol", "date", F.when(row_no() <= F.floor(n * (1 - out_share) + 1e-9), "in").otherwise("out").alias("part"))


def t_statistics(rets: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean, t statistic and the closed-form one-sided p-value of returns (key, r)."""
    a = rets.where("r is not null").groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    t = F.col("mu") / (F.col("sd") / F.sqrt("n") + 1e-10)
    return a.where("n > 1").select(key, "n", F.round("mu", 8).alias("mu"), F.round(t, 4).alias("tstat"), F.round(F.greatest(F.lit(0.0), 0.5 * (1 - F.tanh(t / (2**0.5)))), 4).alias("pvalue"))


PRIME = 2**31 - 1


def poisson_cuts(most: int = 8) -> list[int]:
    """Where a uniform integer below PRIME passes the distribution of Poisson(1)."""
    p, total, cuts = math.exp(-1), 0.0, []
    for k in range(most):
        total += p
        cuts.append(int(total * PRIME))
        p /= k + 1
    return cuts


POISSON_CUTS = poisson_cuts()
#: Symbols whose sums a task holds, and rows that are weighed at once: few enough for their replicates to stay in a core's cache.
HELD_KEYS, WEIGHED_ROWS = 256, 32


def replicate_sums(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches (key, r, h1, h2) to sums of ``r * weight`` and ``weight`` of each replicate, as arrays, one row a key that the task has met."""
    prime, cuts, most, block = PRIME, np.array(POISSON_CUTS, np.uint32), HELD_KEYS, WEIGHED_ROWS

    def weights(h1: np.ndarray, h2: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Poisson weights of rows by replicates. ``PRIME`` is 2**31 - 1, so a remainder is the sum of 31-bit digits."""
        u = h1[:, None] * m + h2[:, None]
        u = (u & prime) + (u >> 31)
        u = ((u & prime) + (u >> 31)).astype(np.uint32)
        u[u == prime] = 0
        w = (u >= cuts[0]).view(np.int8)
        for cut in cuts[1:]:
            w += u >= cut
        return w

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = (np.arange(1, replicates + 1, dtype=np.int64) * 48271 + 11) % prime
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                ends = np.arange(len(held) + 1, dtype=np.int32) * replicates
                arrays = [pa.ListArray.from_arrays(ends, np.concatenate([x[k] for x in held.values()])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), *arrays], ["key", "total", "weight"])
            held.clear()

        for batch in batches:
            keys, r, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            runs = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(runs, runs[1:]):
                if lo < hi:
                    total, weight = held.setdefault(keys[lo], (np.zeros(replicates), np.zeros(replicates, np.int64)))
                for at in range(lo, hi, block):
                    part = slice(at, min(hi, at + block))
                    w = weights(h1[part], h2[part], m)
                    total += r[part] @ w.astype(np.float64)
                    weight += w.sum(axis=0, dtype=np.int16)
            if len(held) > most:
                yield from flushed()
        yield from flushed()

    return sums


def quantile(ordered: Column, p: float) -> Column:
    """The quantile of a sorted array, between two elements in proportion."""
    at = (F.size(ordered) - 1) * p
    lo, hi = F.floor(at), F.ceil(at)
    item = lambda i: F.try_element_at(ordered, (i + 1).cast("int"))
    return F.when(F.size(ordered) > 0, F.when(lo == hi, item(lo)).otherwise((hi - at) * item(lo) + (at - lo) * item(hi)))


def bootstrap(rets: DataFrame, replicates: int = 200, key: str = "symbol", seed: int = 42) -> DataFrame:
    """Bounds of the annual mean return of returns (key, date, r): each row gets a Poisson(1) weight in each replicate, so no resample is built.

    The weight of replicate k follows from ``(h1 * m(k) + h2) mod PRIME`` with two numbers h1, h2 out of the row's md5 (key, date, seed), which is independent between
    rows and pairwise between replicates. Tasks keep sums of ``r * weight`` and ``weight`` per key and replicate as arrays and hand on one row a key; neither rows nor
    keys are multiplied by the replicates.
    """
    h = F.md5(F.concat_ws("|", F.col(key), F.date_format("date", "yyyy-MM-dd"), F.lit(str(seed))))
    number = lambda start: F.conv(F.substring(h, start, 7), 16, 10).cast("long")
    rows = rets.where("r is not null").select(F.col(key).cast("string").alias("key"), "r", number(1).alias("h1"), number(8).alias("h2"))
    parts = rows.mapInArrow(replicate_sums(replicates), "key string, total array<double>, weight array<bigint>")
    added = lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.element_at(c, 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    each = parts.groupBy("key").agg(F.collect_list("total").alias("total"), F.collect_list("weight").alias("weight"))
    means = F.zip_with(added(F.col("total")), added(F.col("weight")), lambda t, w: t / F.nullif(w, F.lit(0)))
    m = each.select("key", F.array_sort(F.array_compact(means)).alias("m"))
    n = F.nullif(F.size("m"), F.lit(0))
    return m.select(
        F.col("key").alias(key), settled(quantile(F.col("m"), 0.05) * 25200, 2).alias("ci_lo"), settled(quantile(F.col("m"), 0.95) * 25200, 2).alias("ci_hi"),
        settled(F.size(F.filter("m", lambda x: x > 0)) / n, 3).alias("pos_rate"))


def consistency(metrics: DataFrame) -> DataFrame:
    """Per symbol: windows, share of profitable ones among those with two trades or more out of sample, and their means."""
    out = metrics.where("part = 'out'")
    good = F.col("trades") >= 2
    return out.groupBy("symbol").agg(
        F.count("*").alias("n_windows"), F.sum("trades").alias("out_trades"), F.count_if(good).alias("n_valid"),
        settled(F.coalesce(F.avg(F.when(good, (F.col("ret_pct") > 0).cast("int"))), F.lit(0.0)), 6).alias("consistency"),
        settled(F.coalesce(F.avg(F.when(good, F.col("ret_pct"))), F.lit(0.0)), 6).alias("avg_out_ret"), settled(F.coalesce(F.avg(F.when(good, F.col("sharpe"))), F.lit(0.0)), 6).alias("avg_out_sharpe"),
        settled(F.coalesce(F.avg(F.when(good, F.col("win_rate"))), F.lit(0.0)), 6).alias("avg_out_win_rate"))


def judge(v: DataFrame, min_sharpe: float = 0.3, min_win: float = 0.35, alpha: float = 0.10, max_decay: float = 1.0, min_consistency: float = 0.5, min_windows: int = 3, min_trades: int = 5) -> DataFrame:
    """Named failures of (n_valid, out_trades, consistency, avg_out_sharpe, avg_out_win_rate, in_sharpe, pvalue); passed when there are none."""
    enough = F.col("out_trades") >= min_trades
    rules: list[tuple[str, Column]] = [
        ("oos_sharpe", F.col("avg_out_sharpe") < min_sharpe), ("oos_win_rate", (F.col("avg_out_win_rate") < min_win) & enough), ("p_value", (F.col("pvalue") > alpha) & (F.col("pvalue") < 1.0) & enough),
        ("overfit", F.col("in_sharpe") - F.col("avg_out_sharpe") > max_decay), ("consistency", (F.col("n_valid") >= min_windows) & (F.col("consistency") < min_consistency)), ("few_trades", ~enough)]
    fails = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return v.withColumn("fails", fails).withColumn("passed", F.size("fails") == 0)
