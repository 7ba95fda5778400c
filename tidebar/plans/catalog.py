"""Registered queries: each a Spark plan over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import by_date, lag, rounded_at, settled
from ..operators import detectors, factors, indicators, metrics, monitoring, quality, registry, regime, strategy, trades, validation
from ..sources import bars as src
from ..streaming import bars as streaming
from ..streaming import monitor
from .sql import account_parts, query, rows, signal_parts

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLE: dict[str, str] = {}
#: Queries whose plans read the bars in several branches.
SHARED = set("""
sg9_actions sg10_scan tp7_pyramid_adds k3_scan_top k7_batch_actions a12_action_distribution e8_calculate_all_batch sg8_style_signals v7_judge mo4_snapshot re5_recommended re6_rotation st3_live_monitor
""".split())
#: A limit that the test bars do reach.
LOW_LIMIT = 0.03


def register(name: str, build: Build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, NaN as null, for comparison."""
    return df.select(*[settled(F.col(f.name), places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def on_bars(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the bars; where several branches of its plan read them, they are kept while it runs."""
    bars = lambda spark, sf: src.bars_walk(spark, sf).persist() if name in SHARED else src.bars_walk(spark, sf)
    register(name, lambda spark, sf: rounded(op(bars(spark, sf))), sql)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c.split('.')[-1]}" for c in columns)


BARS = "symbol, date, open, high, low, close, volume, amount"

# Scans, sources and merges
on_bars("s1_scan_bars", lambda b: b.select(*src.COLUMNS), query("b", f"SELECT {BARS} FROM b"))
on_bars("s2_scan_symbol_range", lambda b: src.scan_range(b, "000003", "1996-01-01", "1996-12-31"), query("b", f"SELECT {BARS} FROM b WHERE symbol = '000003' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
on_bars("s3_full_history", lambda b: src.scan_range(b, "000005", "1995-01-01", "1998-12-31"), query("b", f"SELECT {BARS} FROM b WHERE symbol = '000005' AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"))


def wanted(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("000001", "000004", "999999")])).alias("symbol"))


register("s4_scan_symbols", lambda spark, sf: src.scan_symbols(src.bars_walk(spark, sf), wanted(spark)), query("b", f"SELECT {BARS} FROM b WHERE symbol IN ('000001', '000004', '999999')"))
on_bars("s5_distinct_symbols", lambda b: b.select("symbol").distinct(), query("b", "SELECT DISTINCT symbol FROM b"))


def on_sized_bars(name: str, op: Callable[[DataFrame, int], DataFrame], sql: str) -> None:
    """A query over the bars that also takes a bound of their number, to deal what it merges."""
    register(name, lambda spark, sf: rounded(op(src.bars_walk(spark, sf), src.table_rows(spark, sf, "lineitem"))), sql)


def delta(b: DataFrame) -> DataFrame:
    """Late bars: the last bars of each symbol again at a higher price, and a bar one day later."""
    last = factors.last_bars(b)
    again = last.withColumn("close", rounded_at(F.col("close") * 1.01, 4))
    return again.unionByName(last.withColumn("date", F.date_add("date", 1)))


DELTA = """, last AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
delta AS (SELECT symbol, date, open, high, low, round(close * 1.01, 4) AS close, volume, amount FROM last UNION ALL SELECT symbol, CAST(date + 1 AS DATE), open, high, low, close, volume, amount FROM last)"""[1:]
on_sized_bars("s10_upsert_bars", lambda b, n: src.upsert(b, delta(b), ["symbol", "date"], rows=n), query("b", f"SELECT {BARS} FROM delta UNION ALL SELECT {BARS} FROM b ANTI JOIN delta USING (symbol, date)", DELTA))
on_sized_bars("s11_insert_ignore", lambda b, n: src.insert_ignore(b, delta(b), ["symbol", "date"], rows=n), query("b", f"SELECT {BARS} FROM b UNION ALL SELECT {BARS} FROM delta ANTI JOIN b USING (symbol, date)", DELTA))
on_bars("s17_incremental", lambda b: src.incremental(b, delta(b)), query("b", f"SELECT {BARS} FROM delta WHERE date > (SELECT max(date) FROM b)", DELTA))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor bodies made of the bars: one JSONP text per symbol."""
    return bodies(src.bars_walk(spark, sf))


def bodies(bars: DataFrame) -> DataFrame:
    line = F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *[F.format_string("%.4f", c) for c in ("open", "high", "low", "close")], F.format_string("%.0f", "volume"))
    b = bars.withColumn("line", line)
    return b.groupBy("symbol").agg(F.concat(F.lit('quote_x({"data":"'), F.array_join(F.sort_array(F.collect_list("line")), ";"), F.lit(';bad,row"});')).alias("body"))


def spoilt(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies in which some lines are spoilt, by the day of the month: too short, no date, no price, no whole volume, without a volume."""
    b = src.bars_walk(spark, sf)
    day, text = F.dayofmonth("date"), F.date_format("date", "yyyyMMdd")
    price = lambda c: F.format_string("%.4f", c)
    whole = F.concat_ws(",", F.when(day == 3, F.lit("20011341")).otherwise(text), price("open"), F.when(day == 5, F.lit("n/a")).otherwise(price("high")), price("low"), price("close"), F.when(day == 7, F.lit("12.5")).otherwise(F.format_string("%.0f", "volume")), F.when(day == 9, price("amount")))
    line = F.when(day == 2, F.concat_ws(",", text, price("open"))).when(day == 4, F.concat_ws(",", text, price("open"), price("high"), price("low"), price("close"))).otherwise(whole)
    own = b.select("symbol", F.concat_ws("\u0001", text, line).alias("line"))
    body = F.transform(F.sort_array(F.collect_list("line")), lambda x: F.element_at(F.split(x, "\u0001"), 2))
    return own.groupBy("symbol").agg(F.concat(F.lit('quote_x({"data":"'), F.array_join(body, ";"), F.lit(';"});')).alias("body"))


SPOILT = """sp AS (SELECT symbol, date, day(date) AS d, open, high, low, close, volume, CASE WHEN day(date) = 9 THEN amount ELSE 0 END AS amount,
  CASE WHEN day(date) IN (2, 4) THEN 'fields' WHEN day(date) = 3 THEN 'date' WHEN day(date) = 5 THEN 'price' WHEN day(date) = 7 THEN 'volume' END AS reason FROM b)"""
register("s9_strict_payload", lambda spark, sf: rounded(src.parse_strict(spoilt(spark, sf)).where("reason is null").drop("line", "reason"), 4),
         query("b", "SELECT symbol, date, open, high, low, close, volume, round(amount + 1e-9, 4) AS amount FROM sp WHERE reason IS NULL", SPOILT))
register("s9_quarantine", lambda spark, sf: src.parse_strict(spoilt(spark, sf)).where("reason is not null").groupBy("symbol", "reason").agg(F.count("*").alias("n"), F.max("line").alias("last_line")),
         query("b", """SELECT symbol, reason, count(*) AS n, max(CASE d WHEN 2 THEN t || ',' || printf('%.4f', open) WHEN 4 THEN concat_ws(',', t, printf('%.4f', open), printf('%.4f', high), printf('%.4f', low), printf('%.4f', close))
  ELSE concat_ws(',', CASE WHEN d = 3 THEN '20011341' ELSE t END, printf('%.4f', open), CASE WHEN d = 5 THEN 'n/a' ELSE printf('%.4f', high) END, printf('%.4f', low), printf('%.4f', close), CASE WHEN d = 7 THEN '12.5' ELSE printf('%.0f', volume) END) END) AS last_line
  FROM (SELECT *, strftime(date, '%Y%m%d') AS t FROM sp) WHERE reason IS NOT NULL GROUP BY 1, 2""", SPOILT))
register("s9_parse_payload", lambda spark, sf: src.parse_payloads(payloads(spark, sf)), query("b", "SELECT symbol, date, open, high, low, close, volume, 0.0::DOUBLE AS amount FROM b"))
on_bars("p2_normalise_bars", lambda b: src.normalise_bars(b.select("symbol", "date", "close")),
        query("b", "SELECT symbol, date, close AS open, round(close * 1.005::DOUBLE + 1e-9, 6) AS high, round(close * 0.995::DOUBLE + 1e-9, 6) AS low, close, 1.0::DOUBLE AS volume, 0.0::DOUBLE AS amount FROM b"))
register("a14_bars_from_items", lambda spark, sf: src.bars_from_items(spark, sf), """
WITH i AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS date, round(l_extendedprice / l_quantity + 1e-9, 4) AS price, (l_orderkey, l_linenumber) AS pos, l_quantity FROM lineitem)
SELECT symbol, date, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM i GROUP BY 1, 2""")
TICKS = """WITH e AS (SELECT event_type AS symbol, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, value AS price, (CAST(ts AS TIMESTAMP), event_id) AS pos FROM events)
SELECT symbol, CAST(start AS TIMESTAMPTZ) AS start, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close, count(*) AS volume FROM e GROUP BY 1, 2"""
register("a14_bars_from_ticks", lambda spark, sf: src.bars_from_ticks(src.event_ticks(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
         TICKS.replace("CAST(start AS TIMESTAMPTZ) AS start", "strftime(start, '%Y-%m-%d %H:%M:%S') AS start"))

# Filters and joins
on_bars("p3_min_history", lambda b: b.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where("n >= 530").select("symbol", "date", "n"),
        query("b", "SELECT symbol, date, count(*) OVER (PARTITION BY symbol) AS n FROM b QUALIFY n >= 530"))
on_bars("p5_limit_flags", lambda b: detectors.limit_flags(b, F.lit(LOW_LIMIT)), query("b", "SELECT symbol, date, coalesce(close / c1 - 1 >= 0.03, false) AS limit_up, coalesce(close / c1 - 1 <= -0.03, false) AS limit_down FROM b"))
register("p6_keyword_match", lambda spark, sf: src.read_table(spark, sf, "part").select("p_partkey", quality.keyword_match(F.col("p_name"), ["al", "ro", "green"]).alias("hit")),
         "SELECT p_partkey, contains(p_name, 'al') OR contains(p_name, 'ro') OR contains(p_name, 'green') AS hit FROM part")
register("p7_cap_bucket", lambda spark, sf: src.read_table(spark, sf, "supplier").select("s_suppkey", quality.cap_bucket(F.col("s_acctbal"), 10.0).alias("bucket")),
         "SELECT s_suppkey, CASE WHEN s_acctbal / 10 >= 500 THEN 'large' WHEN s_acctbal / 10 >= 100 THEN 'mid' ELSE 'small' END AS bucket FROM supplier")
on_bars("p8_quality_flags", quality.flags, query("b", """SELECT symbol, date, open <= 0 OR open >= 10000 OR high <= 0 OR high >= 10000 OR low <= 0 OR low >= 10000 OR close <= 0 OR close >= 10000 AS bad_price,
  coalesce(abs(close / c1 - 1) > 0.2, false) AS jump, volume < 0 AS bad_volume, high < low AS crossed FROM b"""))
on_bars("p8_quality_report", lambda b: quality.report(b, b.select("date")), query("b", """SELECT s.symbol, s.bars, s.anomalies, (SELECT count(*) FROM days WHERE date BETWEEN s.lo AND s.hi) - s.bars AS missing,
  round(s.bars / (SELECT count(*) FROM days WHERE date BETWEEN s.lo AND s.hi), 6) AS completeness FROM s""", """
days AS (SELECT DISTINCT date FROM b), s AS (SELECT symbol, count(*) AS bars, count(*) FILTER (abs(close / c1 - 1) > 0.2 OR high < low) AS anomalies, min(date) AS lo, max(date) AS hi FROM b GROUP BY 1)"""))
on_bars("p9_end_date", lambda b: b.where("date <= '1996-06-30'").select(*src.COLUMNS), query("b", f"SELECT {BARS} FROM b WHERE date <= DATE '1996-06-30'"))
on_bars("j3_missing_on_date", lambda b: b.select("symbol").distinct().join(b.join(b.agg(F.max("date").alias("date")), "date").select("symbol"), "symbol", "left_anti"),
        query("b", "SELECT DISTINCT symbol FROM b WHERE symbol NOT IN (SELECT symbol FROM b WHERE date = (SELECT max(date) FROM b))"))
on_bars("j2_pending_symbols", lambda b: b.select("symbol").distinct().join(b.where("date < '1995-01-06'").select("symbol").distinct(), "symbol", "left_anti"),
        query("b", "SELECT DISTINCT symbol FROM b ANTI JOIN (SELECT symbol FROM b WHERE date < DATE '1995-01-06') USING (symbol)"))


def market_regime(b: DataFrame) -> DataFrame:
    """Regime of one market series carried to every symbol's bars; a symbol's own regime where the market has no bar."""
    market = F.max(F.when(F.col("symbol") == "000001", F.col("regime"))).over(Window.partitionBy("date"))
    return regime.detect(b).select("symbol", "date", F.coalesce(market, "regime").alias("regime"))


on_bars("j4_market_regime", market_regime, query("rg", "SELECT o.symbol, o.date, coalesce(m.regime, o.regime) AS regime FROM rg o LEFT JOIN (SELECT date, regime FROM rg WHERE symbol = '000001') m USING (date)"))
register("j8_style_presets", lambda spark, sf: strategy.presets(spark).select("style", "max_holding_days", "min_rr_ratio").join(src.bars_walk(spark, sf).groupBy(F.substring("symbol", 6, 1).alias("g")).agg(F.count("*").alias("bars")), F.lit(True)),
         query("b", "SELECT style, max_holding_days, min_rr_ratio, g, bars FROM (VALUES ('short_term', 5::BIGINT, 1.5::DOUBLE), ('swing', 20, 1.8::DOUBLE), ('medium_term', 60, 2.5::DOUBLE)) p(style, max_holding_days, min_rr_ratio), (SELECT substring(symbol, 6, 1) AS g, count(*) AS bars FROM b GROUP BY 1)"))

# Aggregations
on_bars("a1_counts", lambda b: b.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("lo"), F.max("date").alias("hi")), query("b", "SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(date) AS lo, max(date) AS hi FROM b"))
on_bars("a3_recent_days", lambda b: b.join(b.agg(F.max("date").alias("last")), F.col("date") > F.date_sub("last", 3)).groupBy("date").agg(F.count("*").alias("n")), query("b", "SELECT date, count(*) AS n FROM b WHERE date > (SELECT max(date) FROM b) - 3 GROUP BY 1"))
on_bars("a4_symbols_per_board", lambda b: b.select("symbol", quality.board(F.col("symbol")).alias("board")).groupBy("board").agg(F.countDistinct("symbol").alias("symbols")),
        query("b", "SELECT CASE WHEN symbol LIKE '688%' THEN 'STAR' WHEN symbol LIKE '60%' THEN 'SH' WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN 'GEM' WHEN symbol LIKE '00%' THEN 'SZ' ELSE 'OTHER' END AS board, count(DISTINCT symbol) AS symbols FROM b GROUP BY 1"))
on_bars("a5_coverage", lambda b: b.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n")), query("b", "SELECT symbol, min(date) AS lo, max(date) AS hi, count(*) AS n FROM b GROUP BY 1"))
on_bars("a6_stale_symbols", lambda b: b.groupBy("symbol").agg(F.max("date").alias("last")).join(b.agg(F.max("date").alias("hi")), F.col("last") < F.col("hi")).select("symbol", "last"),
        query("b", "SELECT symbol, max(date) AS last FROM b GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM b)"))
on_bars("a8_coverage_ratio", lambda b: b.groupBy("symbol").agg(F.max((F.col("date") == "1997-06-02").cast("int")).alias("has")).agg(F.sum("has").alias("have"), F.sum(1 - F.col("has")).alias("missing"), (F.avg("has") * 100).alias("pct")),
        query("b", "SELECT CAST(sum(has) AS BIGINT) AS have, CAST(sum(1 - has) AS BIGINT) AS missing, round(avg(has) * 100, 6) AS pct FROM (SELECT symbol, max((date = DATE '1997-06-02')::INT) AS has FROM b GROUP BY 1)"))

# Trailing windows
on_bars("w1_moving_averages", indicators.moving_averages, query("b", "SELECT symbol, date, " + ", ".join(f"round({rows('avg(close)', 1 - p)} + 1e-9, 6) AS ma{p}" for p in (5, 10, 20, 60, 120)) + " FROM b"))
on_bars("w2_partial_averages", indicators.partial_averages, query("b", "SELECT symbol, date, " + ", ".join(f"round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) + 1e-9, 6) AS MA{p}" for p in (5, 10, 20, 60)) + " FROM b"))
on_bars("w4_returns", indicators.returns, query("b", "SELECT symbol, date, close, c1 AS prev_close, round(close / nullif(c1, 0) - 1, 6) AS ret FROM b"))
on_bars("w5_volatility", indicators.volatility, query("b", "SELECT symbol, date, round(CASE WHEN count(r) OVER v >= 2 THEN stddev_samp(r) OVER v * sqrt(252) END, 6) AS volatility FROM (SELECT symbol, date, close / c1 - 1 AS r FROM b) WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
on_bars("w6_rsi_simple", indicators.rsi_simple, query("t", f"SELECT symbol, date, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi_simple FROM (SELECT symbol, date, {rows('avg(greatest(d, 0))', -13)} AS g, {rows('avg(greatest(-d, 0))', -13)} AS l FROM t)"))
on_bars("w7_bollinger", indicators.bollinger, query("bb", "SELECT symbol, date, close, round(mid + 1e-9, 6) AS mid, round(mid + 2 * sd + 1e-9, 6) AS upper, round(mid - 2 * sd + 1e-9, 6) AS lower, round(4 * sd / (mid + 1e-10), 6) AS width, round((close - (mid - 2 * sd)) / (4 * sd + 1e-10), 6) AS pct_b FROM bb"))
on_bars("w9_atr_sma", indicators.atr_sma, query("t", "SELECT symbol, date, round(tr + 1e-9, 6) AS tr, round(avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS atr_sma FROM t"))
on_bars("w11_rsv", lambda b: b.select("symbol", "date", indicators.rsv().alias("rsv")), query("t", "SELECT symbol, date, round(rsv + 1e-9, 6) AS rsv FROM x"))
on_bars("w12_lagged_returns", lambda b: b.select("symbol", "date", *[(F.col("close") / lag("close", n) - 1).alias(f"ret{n}") for n in (5, 19, 20, 60)]),
        query("b", "SELECT symbol, date, " + ", ".join(f"round(close / lag(close, {n}) OVER w - 1, 6) AS ret{n}" for n in (5, 19, 20, 60)) + " FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)"))
on_bars("w15_prior_high", lambda b: b.select("symbol", "date", F.max("high").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-30, -1)).alias("prior_high")),
        query("b", "SELECT symbol, date, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prior_high FROM b"))
on_bars("w18_drawdown", lambda b: trades.breaker(b.select("symbol", "date", F.col("close").alias("total")), 30.0),
        query("b", "SELECT symbol, date, total, round(dd, 6) AS drawdown, max((dd >= 30)::INT) OVER w = 1 AS broken FROM (SELECT symbol, date, close AS total, (max(close) OVER w - close) / max(close) OVER w * 100 AS dd FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)) WINDOW w AS (PARTITION BY symbol ORDER BY date)"))

# Recursive series, signals and adjustment
REC = ("ema12", "ema26", "macd", "signal", "hist", "rsi14", "k", "d", "j", "atr14")
on_bars("e2_recursive_indicators", indicators.recursive_indicators, query("e", f"SELECT symbol, date, {r6(*REC)} FROM i"))
on_bars("e6_rsi_window", indicators.rsi_windowed, query("rw", "SELECT symbol, date, round(rsi_w, 6) AS rsi_window FROM rw"))
on_bars("e7_calculate_all", indicators.calculate_all, query("e bb", "SELECT i.symbol, i.date, i.close, " + ", ".join(f"round(a.ma{p} + 1e-9, 6) AS ma{p}" for p in (5, 20, 60, 120)) + f", round(a.vol_ma20 + 1e-9, 6) AS vol_ma20, round(mid + 2 * sd + 1e-9, 6) AS bb_upper, round(mid - 2 * sd + 1e-9, 6) AS bb_lower, {r6(*REC)} FROM i JOIN bb USING (symbol, date) JOIN a USING (symbol, date)",
        "a AS (SELECT symbol, date, " + ", ".join(f"{rows('avg(close)', 1 - p)} AS ma{p}" for p in (5, 20, 60, 120)) + f", {rows('avg(volume)', -19)} AS vol_ma20 FROM b)"))
on_bars("i6_signals", lambda b: indicators.signals(indicators.calculate_all(b)), query("s", "SELECT symbol, date, macd, rsi14, kdj, boll, combined, decision FROM sig"))
on_bars("i7_tall", lambda b: indicators.tall(indicators.moving_averages(b), ["ma5", "ma20"]), query("b", f"SELECT symbol, date, n AS indicator_name, round(v + 1e-9, 6) AS value FROM (SELECT symbol, date, 'ma5' AS n, {rows('avg(close)', -4)} AS v FROM b UNION ALL SELECT symbol, date, 'ma20', {rows('avg(close)', -19)} FROM b) WHERE v IS NOT NULL"))


def split_bars(b: DataFrame) -> DataFrame:
    """Bars with ex-days: from 1998 on prices are cut to 0.7."""
    cut = F.when(F.col("date") >= "1998-01-01", 0.7).otherwise(1.0)
    return b.select("symbol", "date", *[settled(F.col(c) * cut, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


SPLIT = """u AS (SELECT symbol, date, volume, round(open * c + 1e-9, 4) AS open, round(high * c + 1e-9, 4) AS high, round(low * c + 1e-9, 4) AS low, round(close * c + 1e-9, 4) AS close FROM (SELECT *, CASE WHEN date >= DATE '1998-01-01' THEN 0.7::DOUBLE ELSE 1 END AS c FROM b)),
u1 AS (SELECT *, open / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS q FROM u), u2 AS (SELECT *, CASE WHEN q < 0.88 OR q > 1.12 THEN q ELSE 1 END AS f FROM u1)"""
ADJ = "SELECT symbol, date, " + ", ".join(f"round({c} * a + 1e-9, 4) AS {c}" for c in ("open", "high", "low", "close")) + ", volume, round(a, 6) AS adjust FROM "
on_bars("i11_adjust_backward", lambda b: indicators.adjust_prices(split_bars(b)), query("b", ADJ + "(SELECT *, exp(coalesce(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS a FROM u2)", SPLIT))
on_bars("i11_adjust_forward", lambda b: indicators.adjust_prices(split_bars(b), "forward"), query("b", ADJ + "(SELECT *, exp(-sum(ln(f)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS a FROM u2)", SPLIT))

# Regime, factors, rankings
REGIME = "symbol, date, " + r6("trend", "vol", "mom", "breadth", "risk", "confidence") + ", regime, max_position, max_positions, tradeable"
REGIME_COLS = ["symbol", "date", "trend", "vol", "mom", "breadth", "risk", "confidence", "regime", "max_position", "max_positions", "tradeable"]
on_bars("rg7_regime", lambda b: regime.detect(b).select(*REGIME_COLS), query("rg", f"SELECT {REGIME} FROM rg"))
on_bars("rg8_multi_period", lambda b: factors.last_bars(regime.detect(b)).select("symbol", F.explode(F.array(F.lit(60), F.lit(120), F.lit(250))).alias("period"), "regime").select(
    "symbol", "period", F.when(F.col("period") < regime.MIN_ROWS, "structural").otherwise(F.col("regime")).alias("regime")),
    query("rg", "SELECT symbol, period, CASE WHEN period < 130 THEN 'structural' ELSE regime END AS regime FROM (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), (VALUES (60), (120), (250)) p(period)"))
on_bars("a12_regime_distribution", lambda b: regime.detect(b).groupBy("date", "regime").agg(F.count("*").alias("n")), query("rg", "SELECT date, regime, count(*) AS n FROM rg GROUP BY 1, 2"))
FACTOR = ["symbol", "date", "momentum", "turnover", "trend", "rsi", "vol_price", "cost", "rsi_w", "reason", "passed", "total_score", "grade"]
on_bars("fa8_factor_score", lambda b: factors.score(b).select(*FACTOR), query("fa", f"SELECT symbol, date, {r6('momentum', 'turnover', 'trend', 'rsi', 'vol_price', 'cost', 'rsi_w')}, reason, passed, total_score, grade FROM fa"))
on_bars("k1_ranked", lambda b: factors.ranked(factors.score(b)).select("symbol", "date", "total_score", F.col("rank").cast("long").alias("rank")),
        query("fa", "SELECT symbol, date, total_score, row_number() OVER (PARTITION BY date ORDER BY total_score DESC, symbol) AS rank FROM fa WHERE passed AND total_score >= 45"))
on_bars("k2_select_top", lambda b: factors.select_top(factors.score(b), 3, "B").select("symbol", "date", "grade", "total_score"),
        query("fa", "SELECT symbol, date, grade, total_score FROM fa WHERE passed AND grade <= 'B' QUALIFY row_number() OVER (PARTITION BY date ORDER BY total_score DESC, symbol) <= 3"))

# Detectors, signals, actions
on_bars("sd10_detect_all", lambda b: detectors.detect_all(b, F.lit(LOW_LIMIT)), query("sd", "SELECT symbol, date, style, signal, strength FROM sd", limit="0.03::DOUBLE"))
on_bars("k5_best_signal", lambda b: detectors.best_signal(detectors.detect_all(b)).select("symbol", "date", "signal", "strength"),
        query("sd", "SELECT symbol, date, signal, strength FROM sd WHERE style IN ('short_term', 'swing') AND strength >= 0.5 QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY strength DESC, signal) = 1", limit="0.095::DOUBLE"))
SIGNAL = ["symbol", "date", "stop", "target", "rr", "signal_type", "confidence", "position_pct", "entry", "generated", "valid"]
on_bars("sg6_signals", lambda b: strategy.signals(b).where("n >= 30").select(*SIGNAL), query("sg", "SELECT symbol, date, stop, target, round(rr, 6) AS rr, signal_type, conf AS confidence, position_pct, entry, generated, valid FROM sg WHERE n >= 30"))
ACTION = """SELECT symbol, date, CASE WHEN n < 60 OR NOT tradeable OR NOT passed THEN 'AVOID' WHEN valid THEN 'BUY' WHEN total_score >= 55 AND tradeable THEN 'WATCH' WHEN total_score >= 45 THEN 'HOLD' ELSE 'AVOID' END AS action,
  round(CASE WHEN n < 60 THEN 0 WHEN NOT tradeable THEN 0.9 WHEN NOT passed THEN 0.8 WHEN valid THEN least(0.95, conf + nudge) WHEN total_score >= 55 AND tradeable THEN least(0.75, 0.55 + nudge) WHEN total_score >= 45 THEN 0.4 ELSE 0.7 END + 1e-9, 3) AS action_confidence
  FROM (SELECT sg.*, CASE decision WHEN 'buy' THEN 0.03::DOUBLE WHEN 'sell' THEN -0.03 ELSE 0 END AS nudge FROM sg JOIN sig USING (symbol, date))"""
on_bars("sg9_actions", lambda b: strategy.actions(b).select("symbol", "date", "action", "action_confidence"), query("sg s", ACTION))

# Trade path, ledger, equity, metrics
on_bars("tp1_candidates", trades.candidates, query("ca", "SELECT symbol, date, i, entry, stop, target, position_pct, signal_type, confidence FROM ca"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again, for what several branches of a plan read."""
    path = streaming.shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def states(b: DataFrame) -> DataFrame:
    """The symbols' accounts after every bar, for queries that read both curves and trades; of a position they read the quantity."""
    return kept(trades.accounts(trades.candidate_rows(b)).withColumn("h", F.struct("h.quantity")), "accounts")


def book(b: DataFrame) -> DataFrame:
    return kept(trades.account_trades(trades.accounts(trades.candidate_rows(b), every=False)), "trades")


def curve(b: DataFrame) -> DataFrame:
    return trades.account_curve(trades.accounts(trades.candidate_rows(b))).drop("style")


on_bars("tp2_first_exits", lambda b: trades.exits(trades.candidate_rows(b)).select("symbol", "i", "entry", "exit_i", "exit_date", "exit_raw", "exit_reason"), query("px", "SELECT symbol, i, entry, exit_i, exit_date, round(exit_raw, 6) AS exit_raw, exit_reason FROM px"))
on_bars("tp3_ledger", lambda b: book(b).select("symbol", "i", "exit_i", "quantity", "exit_price", "cash_in", "cash_out", "pnl_pct", "pnl"), query("le", f"SELECT symbol, i, exit_i, quantity, exit_price, {r6('cash_in', 'cash_out', 'pnl_pct', 'pnl')} FROM le"))
on_bars("tp6_equity", curve, query("eq", "SELECT symbol, date, i, capital, position_val, total, return_pct FROM eq"))
on_bars("a9_exit_reasons", lambda b: book(b).groupBy("exit_reason", "signal_type").agg(F.count("*").alias("n")), query("le", "SELECT exit_reason, signal_type, count(*) AS n FROM le GROUP BY 1, 2"))
on_bars("m5_curve_metrics", lambda b: metrics.curve_metrics(curve(b)), query("mt", "SELECT * FROM mc"))
on_bars("m6_trade_metrics", lambda b: metrics.trade_metrics(book(b)), query("mt", "SELECT * FROM mt"))


def backtest(b: DataFrame) -> DataFrame:
    s = states(b)
    return metrics.backtest_rows(s, trades.account_trades(s), trades.account_curve(s))


RESULT = """br AS (SELECT s.symbol, coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades, """ + ", ".join(
    f"CASE WHEN mt.symbol IS NULL THEN 0 ELSE coalesce({c}, 0) END AS {c}" for c in ("win_rate", "profit_factor", "avg_trade_pct", "stop_pct", "target_pct", "trail_pct", "time_pct", "n_days", "total_return_pct", "sharpe", "sortino", "max_drawdown_pct", "calmar")
) + ", CASE WHEN mt.symbol IS NULL THEN 'skip' ELSE 'ok' END AS status FROM (SELECT DISTINCT symbol FROM b) s LEFT JOIN mt USING (symbol) LEFT JOIN mc USING (symbol))"
on_bars("m7_backtest_rows", backtest, query("mt", "SELECT * FROM br", RESULT))
on_bars("m8_batch_summary", lambda b: metrics.batch_summary(backtest(b)), query("mt", """SELECT count(*) AS n_active, CAST(sum(total_trades) AS BIGINT) AS n_trades, round(avg(win_rate), 6) AS avg_win_rate, round(avg(total_return_pct), 4) AS avg_return, round(median(total_return_pct), 4) AS median_return,
  round(avg(max_drawdown_pct), 4) AS avg_drawdown, round(avg(least(profit_factor, 100)), 4) AS avg_profit_factor, round(avg((total_return_pct > 0)::INT) * 100, 4) AS profitable_pct, arg_max(symbol, (total_return_pct, symbol)) AS best, arg_min(symbol, (total_return_pct, symbol)) AS worst FROM br WHERE total_trades > 0""", RESULT))
on_bars("tp7_pyramid_adds", lambda b: trades.pyramid_adds(trades.candidates(b), b), query("ca", """SELECT ca.symbol, ca.i, min(b.rn - 1) AS add_i, arg_min(b.date, b.rn) AS add_date, arg_min(b.close, b.rn) AS add_price, round((any_value(entry) * 2 + arg_min(b.close, b.rn)) / 3, 6) AS average
  FROM ca JOIN b ON b.symbol = ca.symbol AND b.rn - 1 BETWEEN ca.i + 1 AND ca.i + 20 AND (b.close - entry) / entry >= 0.05 GROUP BY 1, 2"""))
BASE_STYLE = """sy AS (SELECT 'base' AS style, 20 AS hold, 0.06::DOUBLE AS act, 0.04::DOUBLE AS trail, 0.04::DOUBLE AS be, 0.04::DOUBLE AS least_stop), ac0 AS (SELECT sy.*, symbol, i, entry, stop, target, position_pct, signal_type FROM ca, sy)"""
on_bars("tp7_pyramid_account", lambda b: trades.account_trades(trades.accounts(trades.candidate_rows(b), risk=trades.Risk(), every=False)).select("symbol", "i", "signal_type", "quantity", "adds", "entry", "exit_i", "exit_raw", "exit_price", "exit_reason", "cash_in", "cash_out", "pnl_pct", "pnl"),
        query("ca", f"SELECT symbol, i, signal_type, quantity, adds, entry, exit_i, round(exit_raw, 6) AS exit_raw, exit_price, exit_reason, {r6('cash_in', 'cash_out', 'pnl_pct', 'pnl')} FROM acct", BASE_STYLE + "," + account_parts(risk=True)))
STREAK = "st AS (SELECT *, CAST(sum((pnl <= 0)::INT) OVER (PARTITION BY symbol, island ORDER BY exit_i, i) AS BIGINT) AS streak FROM (SELECT *, sum((pnl > 0)::INT) OVER (PARTITION BY symbol ORDER BY exit_i, i ROWS UNBOUNDED PRECEDING) AS island FROM le))"
on_bars("w19_loss_streaks", lambda b: trades.loss_streaks(book(b)).select("symbol", "i", F.col("streak").cast("long").alias("streak")), query("le", "SELECT symbol, i, streak FROM st", STREAK))
on_bars("tp9_cooldowns", lambda b: trades.cooldowns(book(b)), query("le", "SELECT DISTINCT symbol, unnest(range(exit_i, exit_i + 3)) AS blocked_i FROM st WHERE streak >= 3", STREAK))
on_bars("tp8_circuit_breaker", lambda b: trades.breaker(curve(b)), query("eq", "SELECT symbol, date, total, round(dd, 6) AS drawdown, max((dd >= 8)::INT) OVER w = 1 AS broken FROM (SELECT symbol, date, total, (max(total) OVER w - total) / max(total) OVER w * 100 AS dd FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY date)) WINDOW w AS (PARTITION BY symbol ORDER BY date)"))

# Validation
on_bars("v1_walk_windows", validation.walk_windows, query("b", "SELECT symbol, w, w * 50 AS train_from, w * 50 + 200 AS train_to, w * 50 + 200 AS valid_from, w * 50 + 330 AS valid_to FROM (SELECT symbol, unnest(range(0, (n - 330) // 50 + 1)) AS w FROM (SELECT symbol, count(*) AS n FROM b GROUP BY 1) WHERE n >= 330)"))


def windows_of(b: DataFrame) -> DataFrame:
    s = states(b)
    return validation.window_metrics(validation.walk_windows(s), trades.account_trades(s), trades.account_curve(s))


WINDOWS = """wi AS (SELECT symbol, w, part, CASE part WHEN 'in' THEN w * 50 ELSE w * 50 + 200 END AS lo, CASE part WHEN 'in' THEN w * 50 + 200 ELSE w * 50 + 330 END AS hi
  FROM (SELECT symbol, unnest(range(0, (n - 330) // 50 + 1)) AS w FROM (SELECT symbol, count(*) AS n FROM b GROUP BY 1) WHERE n >= 330), (VALUES ('in'), ('out')) p(part)),
wp AS (SELECT wi.symbol, w, part, eq.i, total, total / lag(total) OVER (PARTITION BY wi.symbol, w, part ORDER BY eq.i) - 1 AS r FROM wi JOIN eq ON eq.symbol = wi.symbol AND eq.i >= lo AND eq.i < hi),
we AS (SELECT symbol, w, part, arg_max(total, i) / arg_min(total, i) - 1 AS ret, avg(r) AS mu, stddev_samp(r) AS sd FROM wp GROUP BY 1, 2, 3),
wt AS (SELECT wi.symbol, w, part, count(*) AS trades, avg((pnl > 0)::INT) AS win_rate FROM wi JOIN le ON le.symbol = wi.symbol AND le.i >= lo AND le.i < hi GROUP BY 1, 2, 3),
wm AS (SELECT symbol, w, part, coalesce(trades, 0) AS trades, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(ret * 100, 0), 6) AS ret_pct, round(CASE WHEN coalesce(trades, 0) > 0 AND sd > 0 THEN (mu - 0.03 / 252) / sd * sqrt(252) ELSE 0 END, 6) AS sharpe
  FROM wi LEFT JOIN we USING (symbol, w, part) LEFT JOIN wt USING (symbol, w, part))"""
on_bars("v2_window_metrics", windows_of, query("eq", "SELECT * FROM wm", WINDOWS))
on_bars("v3_split_sample", validation.split_sample, query("b", "SELECT symbol, date, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE + 1e-9) THEN 'in' ELSE 'out' END AS part FROM b"))
on_bars("v4_t_statistics", lambda b: validation.t_statistics(b.select("symbol", "date", (F.col("close") / lag("close") - 1).alias("r"))),
        query("b", "SELECT symbol, n, round(mu, 8) AS mu, round(t, 4) AS tstat, round(greatest(0, 0.5 * (1 - tanh(t / sqrt(2)))), 4) AS pvalue FROM (SELECT symbol, count(r) AS n, avg(r) AS mu, avg(r) / (stddev_samp(r) / sqrt(count(r)) + 1e-10) AS t FROM (SELECT symbol, close / c1 - 1 AS r FROM b) GROUP BY 1)").replace("round(mu, 8)", "round(round(mu, 8), 6)"))
CUTS = ", ".join(map(str, validation.POISSON_CUTS))
on_bars("v5_bootstrap", lambda b: validation.bootstrap(b.select("symbol", "date", (F.col("close") / lag("close") - 1).alias("r")), 2000), query("b", f"""SELECT symbol, round(quantile_cont(m, 0.05) * 25200 + 1e-9, 2) AS ci_lo, round(quantile_cont(m, 0.95) * 25200 + 1e-9, 2) AS ci_hi, round(avg((m > 0)::INT) + 1e-9, 3) AS pos_rate
  FROM (SELECT symbol, k, sum(r * w) / nullif(sum(w), 0) AS m FROM (SELECT symbol, k, r, {' + '.join(f'(u >= {c})::INT' for c in validation.POISSON_CUTS)} AS w FROM bu) GROUP BY 1, 2) GROUP BY 1""", f"""
bh AS (SELECT symbol, close / c1 - 1 AS r, md5(symbol || '|' || strftime(date, '%Y-%m-%d') || '|42') AS h FROM b WHERE c1 IS NOT NULL),
bi AS (SELECT symbol, r, ('0x' || substr(h, 1, 7))::BIGINT AS h1, ('0x' || substr(h, 8, 7))::BIGINT AS h2 FROM bh),
bu AS (SELECT symbol, r, k, (h1 * ((k * 48271 + 11) % {validation.PRIME}) + h2) % {validation.PRIME} AS u FROM bi, range(1, 2001) t(k))"""))
CONSIST = WINDOWS + """,
vc AS (SELECT symbol, count(*) AS n_windows, CAST(sum(trades) AS BIGINT) AS out_trades, count(*) FILTER (trades >= 2) AS n_valid, round(coalesce(avg((ret_pct > 0)::INT) FILTER (trades >= 2), 0), 6) AS consistency,
  round(coalesce(avg(ret_pct) FILTER (trades >= 2), 0), 6) AS avg_out_ret, round(coalesce(avg(sharpe) FILTER (trades >= 2), 0), 6) AS avg_out_sharpe, round(coalesce(avg(win_rate) FILTER (trades >= 2), 0), 6) AS avg_out_win_rate FROM wm WHERE part = 'out' GROUP BY 1)"""
on_bars("v6_consistency", lambda b: validation.consistency(windows_of(b)), query("eq", "SELECT * FROM vc", CONSIST))


def judged(b: DataFrame) -> DataFrame:
    m = windows_of(b).persist()
    inside = m.where("part = 'in'").groupBy("symbol").agg(F.round(F.avg("sharpe"), 6).alias("in_sharpe"))
    p = validation.t_statistics(b.select("symbol", "date", (F.col("close") / lag("close") - 1).alias("r"))).select("symbol", "pvalue")
    j = validation.judge(validation.consistency(m).join(inside, "symbol").join(p, "symbol"))
    return j.select("symbol", F.array_join("fails", ",").alias("fails"), "passed")


on_bars("v7_judge", judged, query("eq", """SELECT symbol, array_to_string(f, ',') AS fails, len(f) = 0 AS passed FROM (SELECT symbol, list_filter([CASE WHEN avg_out_sharpe < 0.3 THEN 'oos_sharpe' END, CASE WHEN avg_out_win_rate < 0.35 AND out_trades >= 5 THEN 'oos_win_rate' END,
  CASE WHEN pvalue > 0.10 AND pvalue < 1 AND out_trades >= 5 THEN 'p_value' END, CASE WHEN in_sharpe - avg_out_sharpe > 1 THEN 'overfit' END, CASE WHEN n_valid >= 3 AND consistency < 0.5 THEN 'consistency' END, CASE WHEN out_trades < 5 THEN 'few_trades' END], lambda q: q IS NOT NULL) AS f
  FROM vc JOIN (SELECT symbol, round(avg(sharpe), 6) AS in_sharpe FROM wm WHERE part = 'in' GROUP BY 1) USING (symbol) JOIN (SELECT symbol, round(greatest(0, 0.5 * (1 - tanh(t / sqrt(2)))), 4) AS pvalue FROM (SELECT symbol, avg(r) / (stddev_samp(r) / sqrt(count(r)) + 1e-10) AS t FROM (SELECT symbol, close / c1 - 1 AS r FROM b) GROUP BY 1)) USING (symbol))""", CONSIST))
on_bars("v8_longest_symbols", lambda b: b.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(5), query("b", "SELECT symbol, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, symbol LIMIT 5"))

# Monitoring and registry over the ledger: a symbol's account stands for a strategy
LOG = "lg AS (SELECT symbol AS strategy_id, i, pnl, pnl_pct FROM le)"


def log_of(b: DataFrame) -> DataFrame:
    return book(b).select(F.col("symbol").alias("strategy_id"), "i", "pnl", "pnl_pct")


def rolling_sql(n: int, name: str) -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY i DESC) AS back FROM lg),
{name}1 AS (SELECT *, exp(sum(ln(1 + pnl_pct / 100)) OVER (PARTITION BY strategy_id ORDER BY i)) AS cum FROM {name}0 WHERE back <= {n}),
{name}2 AS (SELECT *, (greatest(max(cum) OVER (PARTITION BY strategy_id ORDER BY i), 1) - cum) / greatest(max(cum) OVER (PARTITION BY strategy_id ORDER BY i), 1) * 100 AS dd FROM {name}1),
{name}3 AS (SELECT strategy_id, count(*) AS n, avg(pnl_pct / 100) AS mu, coalesce(stddev_samp(pnl_pct / 100), 1e-8) AS sd, avg((pnl > 0)::INT) AS win, arg_max(cum, i) AS cum, max(dd) AS dd FROM {name}2 GROUP BY 1),
{name}4 AS (SELECT strategy_id, count(*) AS all_trades, count(*) FILTER (i > coalesce(lw, -1)) AS consec_losses FROM lg JOIN (SELECT strategy_id, max(i) FILTER (pnl > 0) AS lw FROM lg GROUP BY 1) USING (strategy_id) GROUP BY 1),
{name} AS (SELECT strategy_id, all_trades, round(CASE WHEN sd > 1e-10 THEN mu / sd * sqrt(252.0 / n) ELSE 0 END, 4) AS sharpe, round(win, 4) AS win_rate, round((cum - 1) * 100, 4) AS ret, round(dd, 4) AS max_dd, consec_losses FROM {name}3 JOIN {name}4 USING (strategy_id))"""


on_bars("mo1_rolling_metrics", lambda b: monitoring.rolling_metrics(log_of(b), 20), query("le", "SELECT * FROM rm", LOG + "," + rolling_sql(20, "rm")))


def strategies_of(b: DataFrame) -> DataFrame:
    """A strategy table over the symbols: status by the symbol's last digit, validation figures from its returns."""
    r = b.select("symbol", (F.col("close") / lag("close") - 1).alias("r"))
    g = r.groupBy("symbol").agg(F.round(F.avg("r") * 1000, 4).alias("validation_sharpe"), F.round(F.avg((F.col("r") > 0).cast("int")), 4).alias("validation_win_rate"), F.round(F.sum("r") * 10, 4).alias("validation_ret_pct"))
    d = F.substring("symbol", 6, 1)
    status = F.when(d.isin("1", "2", "3", "4"), "active").when(d.isin("5", "6", "7"), "degraded").when(d == "8", "candidate").otherwise("retired")
    return g.select(F.col("symbol").alias("strategy_id"), status.alias("status"), "validation_sharpe", "validation_win_rate", "validation_ret_pct", F.lit(None).cast("double").alias("live_max_dd"),
                    F.when(d == "5", F.to_date(F.lit("2001-06-01"))).alias("degraded_since"))


STRATS = """sr AS (SELECT symbol AS strategy_id, CASE WHEN substring(symbol, 6, 1) IN ('1', '2', '3', '4') THEN 'active' WHEN substring(symbol, 6, 1) IN ('5', '6', '7') THEN 'degraded' WHEN substring(symbol, 6, 1) = '8' THEN 'candidate' ELSE 'retired' END AS status,
  round(avg(close / c1 - 1) * 1000, 4) AS validation_sharpe, round(avg((close / c1 - 1 > 0)::INT), 4) AS validation_win_rate, round(sum(close / c1 - 1) * 10, 4) AS validation_ret_pct, CASE WHEN substring(symbol, 6, 1) = '5' THEN DATE '2001-06-01' END AS degraded_since FROM b GROUP BY 1)"""


def snapshot_of(b: DataFrame) -> DataFrame:
    log = log_of(b)
    s = monitoring.snapshot(strategies_of(b), monitoring.rolling_metrics(log, 20), monitoring.rolling_metrics(log, 60), F.to_date(F.lit("2001-12-01")))
    return s.select("strategy_id", "status", "action", "rules", "sharpe", "max_dd", "consec_losses")


def live_monitor(b: DataFrame) -> DataFrame:
    """The trades of all accounts replayed through the live monitor in three periods; -1 stands for the index where no trade made the check."""
    log = book(b).select(F.col("symbol").alias("strategy_id"), F.col("exit_date").cast("timestamp").alias("closed_at"), "i", "pnl", "pnl_pct")
    found = monitor.replay(log, strategies_of(b), streaming.shared_folder(b.sparkSession, "st3"), ["1997-06-01", "1999-09-01"])
    return found.withColumns({"checked_at": F.to_date("checked_at"), "i": F.coalesce("i", F.lit(-1).cast("long"))})


def rolled(n: int, name: str) -> str:
    """Rolling figures of the last ``n`` trades at each trade of ``lt``."""
    return f"""{name}0 AS (SELECT a.strategy_id, a.nth, b.pnl, b.pnl_pct / 100 AS r, b.nth AS k, exp(sum(ln(1 + b.pnl_pct / 100)) OVER (PARTITION BY a.strategy_id, a.nth ORDER BY b.nth)) AS cum FROM lt a JOIN lt b ON b.strategy_id = a.strategy_id AND b.nth BETWEEN a.nth - {n - 1} AND a.nth),
{name}1 AS (SELECT *, greatest(max(cum) OVER (PARTITION BY strategy_id, nth ORDER BY k), 1) AS peak FROM {name}0),
{name}2 AS (SELECT strategy_id, nth, count(*) AS n, avg(r) AS mu, coalesce(stddev_samp(r), 1e-8) AS sd, avg((pnl > 0)::INT) AS win, arg_max(cum, k) AS cum, max((peak - cum) / peak * 100) AS dd FROM {name}1 GROUP BY 1, 2),
{name} AS (SELECT strategy_id, nth, round(CASE WHEN sd > 1e-10 THEN mu / sd * sqrt(252.0 / n) ELSE 0 END, 4) AS sharpe, round(win, 4) AS win_rate, round((cum - 1) * 100, 4) AS ret, round(dd, 4) AS max_dd FROM {name}2)"""


MONITOR = STRATS + """,
lt AS MATERIALIZED (SELECT symbol AS strategy_id, exit_date AS t, i, row_number() OVER (PARTITION BY symbol ORDER BY exit_date, i) AS nth, pnl, pnl_pct FROM le),
""" + rolled(20, "near") + "," + rolled(60, "far") + """,
ck AS MATERIALIZED (SELECT lt.*, near.sharpe, near.win_rate, near.ret, near.max_dd, sr.status AS status0, sr.validation_sharpe AS vs, sr.degraded_since AS since0,
    CAST(lt.nth - coalesce(max(CASE WHEN pnl > 0 THEN lt.nth END) OVER (PARTITION BY lt.strategy_id ORDER BY lt.nth), 0) AS BIGINT) AS streak, coalesce(lag(near.max_dd) OVER (PARTITION BY lt.strategy_id ORDER BY lt.nth), 0) AS dd_before, far.sharpe AS ls, far.max_dd AS ld
  FROM lt JOIN near USING (strategy_id, nth) JOIN far USING (strategy_id, nth) JOIN sr USING (strategy_id) WHERE sr.status IN ('active', 'degraded')),
rk AS (SELECT *, sharpe >= 0.3 AND win_rate >= 0.4 AND streak < 3 AS well,
  array_to_string(list_filter([CASE WHEN nth >= 5 AND sharpe < 0 THEN 'R1' END, CASE WHEN nth >= 10 AND win_rate < 0.3 THEN 'R2' END, CASE WHEN nth >= 5 AND vs IS NOT NULL AND max_dd > 2 * CASE WHEN dd_before = 0 THEN 5 ELSE dd_before END THEN 'R3' END, CASE WHEN nth >= 5 AND streak >= 5 THEN 'R5' END], lambda q: q IS NOT NULL), ',') AS down,
  array_to_string(list_filter([CASE WHEN nth >= 60 AND ls < 0 THEN 'E2' END, CASE WHEN ld > 20 THEN 'E3' END, CASE WHEN vs - sharpe > 1.5 THEN 'E4' END], lambda q: q IS NOT NULL), ',') AS outs FROM ck),
mo AS (
  SELECT strategy_id, CAST(0 AS BIGINT) AS nth, status, degraded_since AS since, CAST(NULL AS DATE) AS t, CAST(NULL AS BIGINT) AS i, CAST('' AS VARCHAR) AS action, CAST('' AS VARCHAR) AS rules FROM sr WHERE status IN ('active', 'degraded')
  UNION ALL
  SELECT strategy_id, CASE WHEN action = 'expire' THEN nth - 1 ELSE nth END, CASE action WHEN 'degrade' THEN 'degraded' WHEN 'recover' THEN 'active' WHEN 'retire' THEN 'retired' WHEN 'expire' THEN 'retired' ELSE status END,
    CASE action WHEN 'degrade' THEN t WHEN 'recover' THEN NULL ELSE since END, CASE WHEN action = 'expire' THEN CAST(since + 60 AS DATE) ELSE t END, CASE WHEN action = 'expire' THEN NULL ELSE i END, CASE WHEN action = 'expire' THEN 'retire' ELSE action END,
    CASE action WHEN 'degrade' THEN down WHEN 'retire' THEN concat_ws(',', CASE WHEN t >= since + 60 THEN 'E1' END, nullif(outs, '')) WHEN 'expire' THEN 'E1' ELSE '' END
  FROM (SELECT rk.*, mo.status, mo.since, CASE WHEN mo.status = 'active' THEN CASE WHEN down <> '' THEN 'degrade' ELSE 'ok' END WHEN rk.t > mo.since + 60 THEN 'expire' WHEN well THEN 'recover' WHEN outs <> '' OR coalesce(rk.t >= mo.since + 60, false) THEN 'retire' ELSE 'ok' END AS action
        FROM mo JOIN rk ON rk.strategy_id = mo.strategy_id AND rk.nth = mo.nth + 1 WHERE mo.status <> 'retired')),
mx AS (SELECT strategy_id, nth, 'retired' AS status, CAST(since + 60 AS DATE) AS t, CAST(NULL AS BIGINT) AS i, 'retire' AS action, 'E1' AS rules FROM (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY nth DESC, (action = 'retire') DESC) = 1) WHERE status = 'degraded' AND since + 60 < (SELECT max(t) FROM lt))"""
on_bars("st3_live_monitor", live_monitor, query("le", """SELECT m.strategy_id, m.t AS checked_at, coalesce(m.i, -1) AS i, m.nth AS n, coalesce(sharpe, 0) AS sharpe, coalesce(win_rate, 0) AS win_rate, coalesce(ret, 0) AS ret, coalesce(max_dd, 0) AS max_dd, coalesce(streak, 0) AS consec_losses, action, rules, m.status
  FROM (SELECT strategy_id, nth, status, t, i, action, rules FROM mo WHERE action <> '' UNION ALL SELECT * FROM mx) m LEFT JOIN ck ON ck.strategy_id = m.strategy_id AND ck.nth = m.nth""", MONITOR))
SNAP = LOG + "," + rolling_sql(20, "rs") + "," + rolling_sql(60, "rl") + "," + STRATS + """,
sn AS (SELECT sr.*, coalesce(rs.sharpe, 0) AS sharpe, coalesce(rs.win_rate, 0) AS win_rate, coalesce(rs.max_dd, 0) AS max_dd, coalesce(rs.consec_losses, 0) AS consec_losses, coalesce(rs.all_trades, 0) AS n, coalesce(rl.sharpe, 0) AS ls, coalesce(rl.max_dd, 0) AS ld
  FROM sr LEFT JOIN rs USING (strategy_id) LEFT JOIN rl USING (strategy_id) WHERE status IN ('active', 'degraded')),
sq AS (SELECT *, sharpe >= 0.3 AND win_rate >= 0.4 AND consec_losses < 3 AS well,
  list_filter([CASE WHEN n >= 5 AND sharpe < 0 THEN 'R1' END, CASE WHEN n >= 10 AND win_rate < 0.3 THEN 'R2' END, CASE WHEN n >= 5 AND validation_sharpe IS NOT NULL AND max_dd > 10 THEN 'R3' END, CASE WHEN n >= 5 AND consec_losses >= 5 THEN 'R5' END], lambda q: q IS NOT NULL) AS down,
  list_filter([CASE WHEN DATE '2001-12-01' - degraded_since >= 60 THEN 'E1' END, CASE WHEN n >= 60 AND ls < 0 THEN 'E2' END, CASE WHEN ld > 20 THEN 'E3' END, CASE WHEN validation_sharpe - sharpe > 1.5 THEN 'E4' END], lambda q: q IS NOT NULL) AS outs FROM sn)"""
on_bars("mo4_snapshot", snapshot_of, query("le", """SELECT strategy_id, status, CASE WHEN status = 'active' AND len(down) > 0 THEN 'degrade' WHEN status = 'degraded' AND well THEN 'recover' WHEN status = 'degraded' AND len(outs) > 0 THEN 'retire' ELSE 'ok' END AS action,
  array_to_string(CASE WHEN status = 'active' THEN down WHEN well THEN [] ELSE outs END, ',') AS rules, sharpe, max_dd, consec_losses FROM sq""", SNAP))


def transitions_of(b: DataFrame) -> DataFrame:
    """A transition log: month ends of each symbol as steps through the life cycle, some of them not allowed."""
    months = b.groupBy("symbol", F.trunc("date", "year").alias("y")).agg(F.max("date").alias("at"), F.count("*").alias("n"))
    step = F.element_at(F.array(*[F.lit(x) for x in ("shadow", "active", "degraded", "active", "retired")]), (F.pmod(F.col("n"), F.lit(5)) + 1).cast("int"))
    return months.select(F.col("symbol").alias("strategy_id"), "at", step.alias("to_status"))


TRANS = "tl AS (SELECT symbol AS strategy_id, max(date) AS pos, (['shadow', 'active', 'degraded', 'active', 'retired'])[count(*) % 5 + 1] AS to_status FROM b GROUP BY symbol, year(date))"
on_bars("re2_violations", lambda b: registry.violations(transitions_of(b)), query("b", """SELECT strategy_id, pos AS "at", to_status, from_status FROM (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY strategy_id ORDER BY pos), 'candidate') AS from_status FROM tl)
  WHERE NOT ((from_status = 'candidate' AND to_status IN ('shadow', 'retired')) OR (from_status = 'shadow' AND to_status IN ('active', 'retired')) OR (from_status = 'active' AND to_status IN ('degraded', 'retired')) OR (from_status = 'degraded' AND to_status IN ('active', 'retired')))""", TRANS))
on_bars("re3_current_status", lambda b: registry.current_status(transitions_of(b)), query("b", "SELECT strategy_id, arg_max(to_status, pos) AS status, max(pos) FILTER (to_status = 'retired') AS retired_at FROM tl GROUP BY 1", TRANS))


def with_live(b: DataFrame) -> DataFrame:
    s, m = strategies_of(b), monitoring.rolling_metrics(log_of(b), 60)
    return s.join(m.select("strategy_id", F.col("sharpe").alias("live_sharpe"), F.col("win_rate").alias("live_win_rate"), F.col("ret").alias("live_ret_pct")), "strategy_id", "left")


LIVE = LOG + "," + rolling_sql(60, "rl") + "," + STRATS + ", lv AS (SELECT sr.*, rl.sharpe AS live_sharpe, rl.win_rate AS live_win_rate, rl.ret AS live_ret_pct FROM sr LEFT JOIN rl USING (strategy_id))"
on_bars("re5_recommended", lambda b: registry.recommended(with_live(b)), query("le", """SELECT strategy_id, status, pick FROM (SELECT *, CASE status WHEN 'active' THEN coalesce(live_sharpe, nullif(validation_sharpe, 0), -999) ELSE coalesce(nullif(live_sharpe, 0), -999) END AS pick FROM lv WHERE status IN ('active', 'degraded'))
  ORDER BY CASE status WHEN 'active' THEN 1 ELSE 2 END, pick DESC, strategy_id LIMIT 1""", LIVE))
on_bars("re6_rotation", lambda b: registry.rotation(with_live(b)), query("le", """SELECT strategy_id, round(coalesce(nullif(live_sharpe, 0), nullif(validation_sharpe, 0), 0) * 0.4 + coalesce(nullif(live_win_rate, 0), nullif(validation_win_rate, 0), 0) * 100 * 0.3 + coalesce(nullif(live_ret_pct, 0), nullif(validation_ret_pct, 0), 0) * 0.2
  + coalesce(validation_win_rate, 0) * 100 * 0.1, 4) AS score FROM lv WHERE status = 'active'""", LIVE))
on_bars("re7_pool_summary", lambda b: registry.pool_summary(strategies_of(b)), query("b", "SELECT status, count(*) AS n, string_agg(strategy_id, ',' ORDER BY strategy_id) AS ids FROM sr GROUP BY 1", STRATS))
on_bars("re7_pool_report", lambda b: registry.pool_report(with_live(b)), query("le", """SELECT *, (SELECT strategy_id FROM pk) AS best_id, (SELECT live_sharpe FROM pk) AS best_sharpe FROM (SELECT count(*) AS total, """
        + ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in registry.EDGES) + ", " + ", ".join(f"coalesce(string_agg(strategy_id, ',' ORDER BY strategy_id) FILTER (status = '{x}'), '') AS {x}_ids" for x in ("active", "degraded", "retired")) + " FROM lv)",
        LIVE + """, pk AS (SELECT strategy_id, live_sharpe FROM (SELECT *, CASE status WHEN 'active' THEN coalesce(live_sharpe, nullif(validation_sharpe, 0), -999) ELSE coalesce(nullif(live_sharpe, 0), -999) END AS pick FROM lv WHERE status IN ('active', 'degraded'))
  ORDER BY CASE status WHEN 'active' THEN 1 ELSE 2 END, pick DESC, strategy_id LIMIT 1)"""))
register("f10_sorted_params", lambda spark, sf: src.read_table(spark, sf, "part").select("p_partkey", registry.strategy_id(F.col("p_name"), F.col("p_brand"), registry.params_text(F.create_map(F.lit("stop"), F.lit("0.05"), F.lit("hold"), F.col("p_size").cast("string")))).alias("id")),
         "SELECT p_partkey, substring(p_brand, 1, 3) || '_' || substring(md5(p_name || ':' || p_brand || ':' || '{\"hold\": ' || p_size || ', \"stop\": 0.05}'), 1, 8) AS id FROM part")
register("f10_strategy_id", lambda spark, sf: src.read_table(spark, sf, "part").select("p_partkey", registry.strategy_id(F.col("p_name"), F.col("p_brand"), F.to_json(F.struct("p_size"))).alias("id")),
         "SELECT p_partkey, substring(p_brand, 1, 3) || '_' || substring(md5(p_name || ':' || p_brand || ':' || '{\"p_size\":' || p_size || '}'), 1, 8) AS id FROM part")

# Text, JSON, calendar
register("f7_trading_days", lambda spark, sf: quality.trading_days(src.read_table(spark, sf, "events").agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))),
         "WITH d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events)), o AS (SELECT day, dayofweek(day) NOT IN (0, 6) AND strftime(day, '%Y-%m-%d') NOT IN ("
         + ", ".join(f"'{h}'" for h in quality.HOLIDAYS) + ") AS open FROM d) SELECT day, open, max(CASE WHEN open THEN day END) OVER (ORDER BY day ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS last_open FROM o")
register("f8_codes_in_text", lambda spark, sf: quality.codes_in_text(src.read_table(spark, sf, "documents"), r"[0-9]{6}"),
         "SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{6}')) AS code FROM documents) GROUP BY 1, 2")
def noted(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on parts that name codes of several exchanges, some of them not the exchange's own."""
    p = src.read_table(spark, sf, "part")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.col("p_partkey"), F.lit(n)) + 1).cast("int"))
    code = F.concat(pick(["60", "68", "00", "30", "43", "83", "90"], 7), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("."), pick(["SH", "SZ", "BJ", "HK"], 4))
    return p.select("p_partkey", F.concat_ws(" ", "p_name", code, F.lit("300750.SZ,300750.SZ"), code).alias("text"))


register("f8_exchange_codes", lambda spark, sf: quality.exchange_codes(noted(spark, sf), "p_partkey"), """
WITH c AS (SELECT p_partkey, (['60', '68', '00', '30', '43', '83', '90'])[p_partkey % 7 + 1] || lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS code, (['SH', 'SZ', 'BJ', 'HK'])[p_partkey % 4 + 1] AS exchange FROM part)
SELECT p_partkey, code, exchange, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM c UNION ALL SELECT p_partkey, '300750', 'SZ' FROM part UNION ALL SELECT p_partkey, '300750', 'SZ' FROM part)
WHERE (exchange = 'SH' AND code LIKE '6%') OR (exchange = 'SZ' AND (code LIKE '00%' OR code LIKE '300%' OR code LIKE '301%')) OR exchange = 'BJ' GROUP BY 1, 2, 3""")
register("f9_links", lambda spark, sf: quality.link_texts(src.read_table(spark, sf, "pages")), "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
register("f11_json_field", lambda spark, sf: src.read_table(spark, sf, "events").groupBy("event_type", F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n")),
         "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")


def streamed_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of the event stream, run to its end into files of the shared folder; of a bar the newest batch counts."""
    schema = src.read_table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/{'events.parquet*'}")
    ticks = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    root = streaming.shared_folder(spark, "st1")
    bars = streaming.stream_bars(ticks)
    streaming.batches(bars, f"{root}/bars", f"{root}/log").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(bars.schema.add("batch", "long")).parquet(f"{root}/bars")
    last = got.groupBy("symbol", "start").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch").alias("b"))
    return last.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "b.*")


register("st1_streamed_bars", streamed_bars, ORACLE["a14_bars_from_ticks"])


def upserted_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches put in by key: all bars, late bars of some symbols, one of them again."""
    b = src.bars_walk(spark, sf).select(*src.COLUMNS)
    late = delta(b).where(F.substring("symbol", 6, 1).isin("1", "7"))
    again = late.where(F.substring("symbol", 6, 1) == "7").withColumn("volume", F.col("volume") + 1)
    t = streaming.BucketTable(spark, streaming.shared_folder(spark, "st2"), buckets=16)
    for n, batch in enumerate((b, late, late, again)):
        t.merge(batch, min(n, 1) if n < 3 else 2)  # the third is the second replayed
    return t.read(b.schema)


register("st2_keyed_upsert", upserted_bars, query("b", f"""SELECT symbol, date, open, high, low, close, volume + CASE WHEN substring(symbol, 6, 1) = '7' THEN 1 ELSE 0 END AS volume, amount FROM delta WHERE substring(symbol, 6, 1) IN ('1', '7')
  UNION ALL SELECT {BARS} FROM b ANTI JOIN (SELECT symbol, date FROM delta WHERE substring(symbol, 6, 1) IN ('1', '7')) USING (symbol, date)""", DELTA))


# Set operations, orders and slices
EARLY, LATE = "date < '1995-03-01'", "date >= '2001-11-02'"
on_bars("u1_union", lambda b: b.where(EARLY).select("symbol", "date").unionByName(b.where(LATE).select("symbol", "date")), query("b", f"SELECT symbol, date FROM b WHERE {EARLY} UNION ALL SELECT symbol, date FROM b WHERE {LATE}"))
on_bars("u3_set_difference", lambda b: b.select("symbol").subtract(b.where(LATE).select("symbol")), query("b", f"SELECT DISTINCT symbol FROM b EXCEPT SELECT symbol FROM b WHERE {LATE}"))
on_bars("u4_intersection", lambda b: b.where(EARLY).select("symbol").intersect(b.where(LATE).select("symbol")), query("b", f"SELECT symbol FROM b WHERE {EARLY} INTERSECT SELECT symbol FROM b WHERE {LATE}"))
on_bars("k8_priority_cap", lambda b: b.groupBy("symbol").agg(F.max("date").alias("last"), F.count("*").alias("n")).orderBy(F.when(F.col("n") >= 530, 0).otherwise(1), "symbol").limit(100),
        query("b", "SELECT symbol, max(date) AS last, count(*) AS n FROM b GROUP BY 1 ORDER BY CASE WHEN count(*) >= 530 THEN 0 ELSE 1 END, symbol LIMIT 100"))
on_bars("w17_crossings", lambda b: b.select("symbol", "date", F.avg("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)).alias("m5"), F.avg("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0)).alias("m20")).select(
    "symbol", "date", *[F.coalesce(x, F.lit(False)).alias(n) for x, n in zip(indicators.crossing("m5", "m20"), ("up", "down"))]).where("up or down"),
    query("b", """SELECT symbol, date, p <= q AND m > n AS up, p >= q AND m < n AS down FROM (SELECT symbol, date, m, n, lag(m) OVER w AS p, lag(n) OVER w AS q FROM (
      SELECT symbol, date, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM b) WINDOW w AS (PARTITION BY symbol ORDER BY date))
      WHERE (p <= q AND m > n) OR (p >= q AND m < n)"""))
on_bars("w20_last_rows", lambda b: b.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 5").select("symbol", "date", "close"),
        query("b", "SELECT symbol, date, close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5"))
DAY = "1997-06-02"


def backfill(b: DataFrame, rows: int) -> DataFrame:
    """The bars of one day that half of the symbols lack, read from the vendor's bodies and put in."""
    odd = F.substring("symbol", 6, 1).isin("1", "3", "5", "7", "9")
    base = b.where((F.col("date") != DAY) | odd)
    come = src.parse_payloads(bodies(b.where(F.col("date") == DAY)))
    missing = come.join(base.where(F.col("date") == DAY).select("symbol"), "symbol", "left_anti")
    return src.upsert(base, missing, ["symbol", "date"], rows=rows)


on_sized_bars("s16_backfill_date", backfill, query("b", f"SELECT symbol, date, open, high, low, close, volume, CASE WHEN date = DATE '{DAY}' AND substring(symbol, 6, 1) IN ('0', '2', '4', '6', '8') THEN 0 ELSE amount END AS amount FROM b"))


def regime_grid(b: DataFrame) -> DataFrame:
    """Each bar with the regime of the last bar before it on a grid of ten, by one more frame over the same rows."""
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    grid = F.last(F.when(F.col("rn") % 10 == 0, F.col("regime")), ignorenulls=True).over(before)
    return regime.detect(b).select("symbol", (F.col("rn") - 1).cast("long").alias("i"), grid.alias("grid")).where("grid is not null")


on_bars("j5_regime_grid", regime_grid, query("rg", "SELECT a.symbol, a.rn - 1 AS i, g.regime AS grid FROM rg a JOIN rg g ON g.symbol = a.symbol AND g.rn = (a.rn - 1) // 10 * 10"))
on_bars("a13_count_by_status", lambda b: strategies_of(b).groupBy("status").agg(F.count("*").alias("n")), query("b", "SELECT status, count(*) AS n FROM sr GROUP BY 1", STRATS))
on_bars("re4_active", lambda b: strategies_of(b).where("status = 'active'").select("strategy_id", "status"), query("b", "SELECT strategy_id, status FROM sr WHERE status = 'active'", STRATS))
on_bars("sg10_scan", lambda b: factors.last_bars(strategy.actions(b)).where("action in ('BUY', 'WATCH') and grade <= 'B'").select("symbol", "date", "action", "total_score", "grade"),
        query("sg s", f"SELECT symbol, date, action, total_score, grade FROM (SELECT a.*, total_score, grade FROM ({ACTION}) a JOIN sg USING (symbol, date) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE action IN ('BUY', 'WATCH') AND grade <= 'B'"))


# Scans, selections and reports over the last bars
ACTED = f"SELECT a.symbol, a.date, action, action_confidence, total_score, grade FROM ({ACTION}) a JOIN sg USING (symbol, date) QUALIFY row_number() OVER (PARTITION BY a.symbol ORDER BY a.date DESC) = 1"


def last_actions(b: DataFrame) -> DataFrame:
    return factors.last_bars(strategy.actions(b).select("symbol", "date", "action", "action_confidence", "total_score", "grade"))


def top(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in by], "symbol").limit(n)


on_bars("k3_scan_top", lambda b: top(last_actions(b).where("action in ('BUY', 'WATCH')"), 10, "action_confidence", "total_score"),
        query("sg s", f"SELECT * FROM ({ACTED}) WHERE action IN ('BUY', 'WATCH') ORDER BY action_confidence DESC, total_score DESC, symbol LIMIT 10"))
on_bars("k4_factor_scan", lambda b: top(factors.last_bars(factors.score(b)).where("passed").select("symbol", "date", "total_score", "grade"), 20, "total_score"),
        query("fa", "SELECT symbol, date, total_score, grade FROM (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE passed ORDER BY total_score DESC, symbol LIMIT 20"))
on_bars("k6_report_top", lambda b: top(backtest(b).where("total_trades > 0").select("symbol", "total_trades", "win_rate", "total_return_pct", "sharpe"), 10, "total_return_pct"),
        query("mt", "SELECT symbol, total_trades, win_rate, total_return_pct, sharpe FROM br WHERE total_trades > 0 ORDER BY total_return_pct DESC, symbol LIMIT 10", RESULT))
on_bars("k7_batch_actions", lambda b: last_actions(b).where("action <> 'AVOID'").withColumn("nth", F.row_number().over(Window.orderBy(F.desc("action_confidence"), "symbol")).cast("long")),
        query("sg s", f"SELECT *, row_number() OVER (ORDER BY action_confidence DESC, symbol) AS nth FROM ({ACTED}) WHERE action <> 'AVOID'"))
on_bars("k9_sample_symbols", lambda b: b.select("symbol").distinct().orderBy(F.md5(F.concat("symbol", F.lit("-7"))), "symbol").limit(20),
        query("b", "SELECT symbol FROM (SELECT DISTINCT symbol FROM b) ORDER BY md5(symbol || '-7'), symbol LIMIT 20"))
on_bars("u2_distinct_codes", lambda b: b.where(EARLY).select("symbol").unionByName(b.where(LATE).select("symbol")).dropDuplicates(["symbol"]), query("b", f"SELECT symbol FROM b WHERE {EARLY} UNION SELECT symbol FROM b WHERE {LATE}"))
register("a7_index_summary", lambda spark, sf: src.read_table(spark, sf, "events").agg(F.countDistinct("event_type").alias("codes"), F.count("*").alias("n"), F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")),
         "SELECT count(DISTINCT event_type) AS codes, count(*) AS n, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events")
on_bars("a10_signal_mix", lambda b: book(b).agg(*[(F.avg((F.col("signal_type") == t).cast("int")) * 100).alias(f"{t}_pct") for t in ("momentum_breakout", "pullback_entry", "volume_surge")]),
        query("le", "SELECT " + ", ".join(f"round(avg((signal_type = '{t}')::INT) * 100, 6) AS {t}_pct" for t in ("momentum_breakout", "pullback_entry", "volume_surge")) + " FROM le"))
on_bars("a12_action_distribution", lambda b: last_actions(b).groupBy("action").agg(F.count("*").alias("n")), query("sg s", f"SELECT action, count(*) AS n FROM ({ACTED}) GROUP BY 1"))
on_bars("rg9_labels", lambda b: factors.last_bars(regime.detect(b)).select("symbol", "tradeable", regime.lookup(regime.LABELS, "regime").alias("label")),
        query("rg", "SELECT symbol, tradeable, CASE regime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in regime.LABELS.items()) + " END AS label FROM (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"))
on_bars("e8_calculate_all_batch", indicators.calculate_all_batch, query("e bb", "SELECT i.symbol, i.date, i.close, " + ", ".join(f"round(avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW), 6) AS MA{p}" for p in (5, 10, 20, 60))
        + f""", round(ret, 6) AS ret, round(CASE WHEN count(ret) OVER v >= 2 THEN stddev_samp(ret) OVER v * sqrt(252) END, 6) AS volatility, round(100 - 100 / (1 + gain / nullif(loss, 0)), 6) AS rsi_simple, round(mid + 2 * sd, 6) AS upper, round(mid - 2 * sd, 6) AS lower,
  round(avg(u.tr) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS atr_sma, {r6(*['i.' + c for c in REC])} FROM i JOIN bb USING (symbol, date) JOIN b USING (symbol, date) JOIN u USING (symbol, date) WINDOW v AS (PARTITION BY b.symbol ORDER BY b.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        f"u AS (SELECT symbol, date, nullif(tr, NULL) AS tr, close / nullif(c1, 0) - 1 AS ret, {rows('avg(greatest(d, 0))', -13)} AS gain, {rows('avg(greatest(-d, 0))', -13)} AS loss FROM t)"))
register("s14_vendor_headers", lambda spark, sf: src.from_vendor(src.bars_walk(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumnsRenamed({v: k for k, v in src.VENDOR_NAMES.items()}), "2000-12-31"),
         query("b", f"SELECT {BARS} FROM b WHERE date > DATE '2000-12-31'"))


def analyses(b: DataFrame) -> DataFrame:
    last = factors.last_bars(b).withColumn("day", F.date_format("date", "yyyyMMdd"))
    old = last.select(F.lit("trend").alias("analyst"), "symbol", "date", F.lit("{}").alias("body")).where(F.substring("symbol", 6, 1) == "1")
    return src.upsert_analysis(old, last, "trend", ["symbol", "day"])


on_bars("s12_upsert_analysis", analyses, query("b", """SELECT 'trend' AS analyst, symbol, max(date) AS date, '{"symbol":"' || symbol || '","day":"' || strftime(max(date), '%Y%m%d') || '"}' AS body FROM b GROUP BY symbol"""))

# Styles
SWING = strategy.STYLES[1]
SWING_SQL = signal_parts("sgin", "sw", "0.05", "0.08", "1.8") + """,
bd AS (SELECT symbol, date, signal AS detector, strength FROM sd WHERE style = 'swing' AND strength >= 0.5 QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY strength DESC, signal) = 1),
sx AS (SELECT sw.*, detector, strength, detector IS NOT NULL AND NOT valid AS own,
  coalesce(strength >= 0.45 AND passed AND total_score >= 55 AND tradeable AND rr >= 1.8 AND stop < entry AND entry < target AND (target - entry) / (entry - stop + 1e-8) >= 1.3, false) AS alone FROM sw LEFT JOIN bd USING (symbol, date))"""
on_bars("sg8_style_signals", lambda b: strategy.style_signals(b, SWING, F.lit(LOW_LIMIT)), query("sg sd", """SELECT symbol, date,
  CASE WHEN own THEN CASE WHEN detector IN ('ma_golden_cross') THEN 'trend_continuation' WHEN detector = 'intraday_surge' THEN 'volume_surge' WHEN detector IN ('pullback_ma', 'volume_divergence') THEN 'pullback_entry' ELSE 'momentum_breakout' END ELSE signal_type END AS signal_type, detector,
  CASE WHEN own THEN round(strength + 1e-9, 3) WHEN detector IS NOT NULL THEN round(greatest(conf, strength * 0.9::DOUBLE) + 1e-9, 3) ELSE conf END AS confidence,
  CASE WHEN own THEN round(least(max_position * (0.5::DOUBLE + strength * least(rr / 2, 1.0) * 0.5), 0.4, max_position / greatest(max_positions, 1)) + 1e-9, 4) ELSE position_pct END AS position_pct, entry, stop, target, round(rr, 6) AS rr
  FROM sx WHERE CASE WHEN own THEN alone WHEN detector IS NOT NULL THEN true ELSE generated END""", SWING_SQL, limit="0.03::DOUBLE"))


def style_comparison(b: DataFrame) -> DataFrame:
    """The same trade metrics for each style preset over all symbols; one plan folds the accounts of all styles together."""
    s = trades.accounts(trades.candidate_rows(b, strategy.STYLES), strategy.STYLES, every=False)
    return metrics.trade_metrics(trades.account_trades(s), "style")


STYLE_ROWS = [("a", "short_term", 5, "0.03", "0.05", "1.5", "1.5", "0.01", "50", "0.42", "p10", 0.04, 0.02, 0.02), ("m", "swing", 20, "0.05", "0.08", "1.8", "2.0", "0.02", "55", "0.45", "prev_high", 0.06, 0.03, 0.04),
              ("z", "medium_term", 60, "0.06", "0.12", "2.5", "2.5", "0.03", "62", "0.50", "high60", 0.10, 0.05, 0.06)]
STYLE_CANDS = "cin9 AS (SELECT cin.*, p10 FROM cin JOIN (SELECT symbol, rn, max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p10 FROM b) q ON q.symbol = cin.symbol AND q.rn = cin.n)," + ",".join(
    signal_parts("cin9", f"c9{k}", low, high, rr, atr, buffer, score, conf, prev) for k, _, _, low, high, rr, atr, buffer, score, conf, prev, *_ in STYLE_ROWS) + ",\nac0 AS (" + " UNION ALL ".join(
    f"SELECT '{style}' AS style, {hold} AS hold, {act}::DOUBLE AS act, {trail}::DOUBLE AS trail, {be}::DOUBLE AS be, {low}::DOUBLE AS least_stop, symbol, i, entry, stop, target, position_pct, signal_type FROM c9{k} WHERE valid"
    for k, style, hold, low, *_, act, trail, be in STYLE_ROWS) + ")"
STYLE_STYLES = "sy AS (" + " UNION ALL ".join(f"SELECT '{style}' AS style, {hold} AS hold, {act}::DOUBLE AS act, {trail}::DOUBLE AS trail, {be}::DOUBLE AS be, {low}::DOUBLE AS least_stop" for _, style, hold, low, *_, act, trail, be in STYLE_ROWS) + ")"
on_bars("m9_style_comparison", style_comparison, query("ca", """SELECT style, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, round(avg((pnl > 0)::INT), 6) AS win_rate,
  round(least(coalesce(sum(pnl) FILTER (pnl > 0), 0) / (abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) + 1e-8), 999.99), 4) AS profit_factor, round(avg(pnl_pct), 4) AS avg_trade_pct,
  round(avg(CASE WHEN exit_reason = 'stop_loss' THEN 100.0 ELSE 0 END), 4) AS stop_pct, round(avg(CASE WHEN exit_reason = 'target_reached' THEN 100.0 ELSE 0 END), 4) AS target_pct,
  round(avg(CASE WHEN exit_reason = 'trailing_stop' THEN 100.0 ELSE 0 END), 4) AS trail_pct, round(avg(CASE WHEN exit_reason = 'time_exit' THEN 100.0 ELSE 0 END), 4) AS time_pct FROM acct GROUP BY 1""",
        STYLE_CANDS + "," + STYLE_STYLES + "," + account_parts(risk=False)))

# Registry steps over the part table and the symbols' strategies
OFFERED = "SELECT substring(p_brand, 1, 3) || '_' || substring(md5(p_name || ':' || p_brand || ':' || '{\"p_size\":' || p_size || '}'), 1, 8) AS strategy_id, p_name AS name, p_brand AS style FROM part"


def registered(spark: SparkSession, sf: str) -> DataFrame:
    offered = src.read_table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("style"), F.to_json(F.struct("p_size")).alias("params_json"), "p_partkey")
    known = offered.where("p_partkey % 3 = 0").select(registry.strategy_id(F.col("name"), F.col("style"), F.col("params_json")).alias("strategy_id"), "name", "style", F.lit("active").alias("status")).distinct()
    return registry.register_new(known, offered.drop("p_partkey"))


register("re1_register", registered, f"WITH o AS ({OFFERED}), k AS (SELECT DISTINCT * FROM ({OFFERED} WHERE p_partkey % 3 = 0)) SELECT *, 'active' AS status FROM k UNION ALL SELECT DISTINCT *, 'candidate' AS status FROM o WHERE strategy_id NOT IN (SELECT strategy_id FROM k)")


def validated_log(b: DataFrame) -> DataFrame:
    s = strategies_of(b).persist()
    results = s.where("validation_sharpe is not null").select("strategy_id", (F.col("validation_sharpe") > 0).alias("passed"), F.col("validation_sharpe").alias("sharpe"))
    return registry.with_validation_log(transitions_of(b), s, results, F.to_date(F.lit("2002-01-01")))


on_bars("re8_validation_log", validated_log, query("b", """SELECT strategy_id, pos AS "at", to_status FROM tl UNION ALL
  SELECT strategy_id, DATE '2002-01-01', CASE WHEN validation_sharpe > 0 THEN 'active' ELSE 'retired' END FROM sr WHERE validation_sharpe IS NOT NULL AND status <> CASE WHEN validation_sharpe > 0 THEN 'active' ELSE 'retired' END""", TRANS + "," + STRATS))
def recorded(b: DataFrame) -> DataFrame:
    """The trades put into a log in three steps, of which the second overlaps both others."""
    t = book(b).select(F.col("symbol").alias("strategy_id"), "i", F.col("exit_date").alias("closed_at"), "pnl", "pnl_pct", "exit_reason")
    path = streaming.shared_folder(b.sparkSession, "log")
    for part in ("i < 300", "i between 250 and 420", "i >= 380"):
        log = registry.record_trades(t.where(part), path)
    return log


on_bars("re9_recorded_trades", recorded, query("le", "SELECT symbol AS strategy_id, i, exit_date AS closed_at, round(pnl, 6) AS pnl, round(pnl_pct, 6) AS pnl_pct, exit_reason FROM le"))
on_bars("re10_notes", lambda b: registry.with_notes(strategies_of(b).select("strategy_id", "status"), transitions_of(b).withColumnRenamed("to_status", "note")).select("strategy_id", "status", F.array_join("notes", ";").alias("notes")),
        query("b", "SELECT strategy_id, status, coalesce((SELECT string_agg(strftime(pos, '%Y-%m-%d') || ' ' || to_status, ';' ORDER BY pos, to_status) FROM tl WHERE tl.strategy_id = sr.strategy_id), '') AS notes FROM sr", TRANS + "," + STRATS))
on_bars("fa5_series_rsi", lambda b: factors.score(indicators.with_wilder_rsi(b), series="rsi14").select("symbol", "date", "rsi_w", "rsi", "reason", "total_score", "grade"),
        query("fs", "SELECT symbol, date, round(rsi_w, 6) AS rsi_w, rsi::DOUBLE AS rsi, reason, total_score, grade FROM fs"))
on_bars("w3_exponential_averages", indicators.exponential_averages, query("b", f"SELECT symbol, date, {r6('ema5', 'ema10', 'ema20', 'ema60')} FROM em", """em AS (
  SELECT symbol, date, rn, close AS ema5, close AS ema10, close AS ema20, close AS ema60 FROM b WHERE rn = 1
  UNION ALL SELECT b.symbol, b.date, b.rn, """ + ", ".join(f"ema{p} + (b.close - ema{p}) * 2 / {p + 1}" for p in (5, 10, 20, 60)) + " FROM em JOIN b ON b.symbol = em.symbol AND b.rn = em.rn + 1)"))
on_bars("fa9_report_lines", lambda b: factors.report_lines(factors.last_bars(factors.score(b))), query("fa", "SELECT symbol, date, CASE WHEN passed THEN '  ' || symbol || ' [' || grade || '] 总分=' || printf('%.1f', round(total_score + 1e-9, 1)) || ' | ' || concat_ws('  ', "
        + ", ".join(f"'{label}:' || printf('%.0f', round({c} * 100, 1))" for c, label in factors.REPORT.items()) + ") ELSE '  ' || symbol || ': ❌ 过滤 (' || reason || ')' END AS line FROM (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"))
on_bars("i8_indicator_records", lambda b: indicators.indicator_records(indicators.calculate_all(b)), query("s", "SELECT symbol, name, round(value, 6) AS value, strftime(date, '%Y-%m-%d') AS timestamp, signal FROM ("
        + " UNION ALL ".join(f"SELECT i.symbol, i.date, '{n}' AS name, i.{v} AS value, s.{n} AS signal FROM i JOIN s USING (symbol, date)" for n, v in indicators.SIGNAL_VALUES.items()) + ")"))
