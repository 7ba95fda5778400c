"""Data quality, calendar, coverage and text-extraction operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exchange holidays on weekdays, 2024 to 2026.
HOLIDAYS = """
2024-01-01 2024-02-09 2024-02-12 2024-02-13 2024-02-14 2024-02-15 2024-02-16 2024-04-04 2024-04-05 2024-05-01 2024-05-02 2024-05-03
2024-06-10 2024-09-16 2024-09-17 2024-10-01 2024-10-02 2024-10-03 2024-10-04 2024-10-07
2025-01-01 2025-01-27 2025-01-28 2025-01-29 2025-01-30 2025-01-31 2025-04-04 2025-05-01 2025-05-02 2025-05-31
2025-10-01 2025-10-02 2025-10-03 2025-10-06 2025-10-07
2026-01-01 2026-02-16 2026-02-17 2026-02-18 2026-02-19 2026-02-20
2026-04-06 2026-05-01 2026-05-04 2026-05-05 2026-06-19 2026-10-01 2026-10-02 2026-10-05 2026-10-06 2026-10-07
""".split()


def flags(bars: DataFrame) -> DataFrame:
    """Rule flags of each bar: price range, daily move, volume, order of high and low."""
    w = Window.partitionBy("symbol").orderBy("date")
    ret = F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad_price = F.exists(F.array(*prices), lambda x: x.isNull() | (x <= 0) | (x >= 10000))
    return bars.select(
        "symbol", "date", bad_price.alias("bad_price"), F.coalesce(F.abs(ret) > 0.2, F.lit(False)).alias("jump"), (F.col("volume") < 0).alias("bad_volume"),
        (F.col("high") < F.col("low")).alias("crossed"))


def report(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per symbol: bars, anomalies, missing days between its first and last date, completeness."""
    f = flags(bars).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.col("bad_price") | F.col("jump") | F.col("bad_volume") | F.col("crossed")).alias("anomalies"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    # Days up to a date are counted once per date, so no symbol is paired with the calendar.
    days = calendar.select("date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("date")))
    lo, hi = days.select(F.col("date").alias("lo"), F.col("nth").alias("a")), days.select(F.col("date").alias("hi"), F.col("nth").alias("b"))
    return f.join(lo, "lo").join(hi, "hi").select(
        "symbol", "bars", "anomalies", (F.col("b") - F.col("a") + 1 - F.col("bars")).cast("long").alias("missing"), F.round(F.col("bars") / (F.col("b") - F.col("a") + 1), 6).alias("completeness"))


def trading_days(days: DataFrame) -> DataFrame:
    """Each day with the last trading day at or before it (at most ten days back)."""
    off = F.dayofweek(F.col("day")).isin(1, 7) | F.date_format("day", "yyyy-MM-dd").isin(*HOLIDAYS)
    w = Window.orderBy("day").rowsBetween(-10, 0)
    return days.select("day", (~off).alias("open")).withColumn("last_open", F.max(F.when(F.col("open"), F.col("day"))).over(w))


def board(symbol: Column) -> Column:
    two, three = F.substring(symbol, 1, 2), F.substring(symbol, 1, 3)
    return F.when(three == "688", "STAR").when(two == "60", "SH").when(three.isin("300", "301"), "GEM").when(two == "00", "SZ").otherwise("OTHER")


def keyword_match(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def cap_bucket(cap: Column, unit: float = 1.0) -> Column:
    x = cap / unit
    return F.when(x >= 500, "large").when(x >= 100, "mid").otherwise("small")


def codes_in_text(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, code, n): every match of a pattern in each text."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("code"))
    return found.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


#: The prefixes of the codes of each exchange; of BJ all.
EXCHANGES = {"SH": ["6"], "SZ": ["00", "300", "301"], "BJ": [""]}


def exchange_codes(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code, exchange, n): codes with an exchange's suffix, as ``600519.SH``, that the exchange's prefixes allow."""
    found = texts.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"([0-9]{6}\.(?:SH|SZ|BJ))"), F.lit(1))).alias("hit"))
    found = found.select(id_col, F.substring("hit", 1, 6).alias("code"), F.substring("hit", 8, 2).alias("exchange"))
    fits = F.lit(False)
    for name, prefixes in EXCHANGES.items():
        for prefix in prefixes:
            fits = fits | ((F.col("exchange") == name) & F.startswith(F.col("code"), F.lit(prefix)))
    return found.where(fits).groupBy(id_col, "code", "exchange").agg(F.count("*").alias("n"))


def link_texts(pages: DataFrame, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """(page_id, link): the distinct link targets of each page."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("link"))
