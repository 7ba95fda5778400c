"""Bars from the relational test tables, scans over bars, and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import by_date, rounded_at, settled

COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "amount"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an input that one task gets.
TASK_ROWS = 50_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df`` by key over as many tasks as its number of rows asks for, so that a task's work and memory do not grow with the input."""
    return df.repartition(tasks_for(rows), *key)


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a test table, counted from the footers of its files."""
    return read_table(spark, sf_dir, name).count()


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per supplier, one bar per ship date; prices follow the running sum of discounts.

    The items are dealt by symbol once, over tasks of ``TASK_ROWS`` rows; days, prices and all frames over a symbol's dates stay in these tasks.
    """
    items = read_table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax", "l_quantity")
    day = (
        dealt(items, table_rows(spark, sf_dir, "lineitem"), "symbol").groupBy("symbol", "date")
        .agg((F.sum(F.col("l_discount") - 0.05) * 0.4).alias("r"), (F.avg("l_tax") * 0.25).alias("spread"), (F.sum("l_quantity") * 10000).cast("double").alias("volume"))
    )
    close = rounded_at(100 * F.exp(F.sum("r").over(by_date())), 4)
    day = day.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(by_date()), "close"))
    return day.select(
        "symbol", "date", "open", rounded_at(F.greatest("open", "close") * (1 + F.col("spread")), 4).alias("high"),
        rounded_at(F.least("open", "close") * (1 - F.col("spread")), 4).alias("low"), "close", "volume",
        rounded_at(F.col("close") * F.col("volume"), 2).alias("amount"),
    )


def bars_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True OHLCV aggregation: unit prices of a supplier's day in order of (order, line)."""
    price = settled(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    at = F.struct("l_orderkey", "l_linenumber")
    items = read_table(spark, sf_dir, "lineitem").withColumn("price", price)
    return items.groupBy(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"))


def bars_from_ticks(ticks: DataFrame, hours: int = 1) -> DataFrame:
    """OHLCV per symbol and time window of a tick table (symbol, ts, price, seq)."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.window("ts", f"{hours} hours").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.count("*").alias("volume")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


def read_jdbc(spark: SparkSession, url: str, table: str, partitions: int = 32, lower: str = "1990-01-01", upper: str = "2030-01-01", **options: str) -> DataFrame:
    """The bar table of a database, read in date ranges."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="date", lowerBound=lower, upperBound=upper, numPartitions=str(partitions), **options).load().select(*COLUMNS)


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One code per line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where("symbol <> ''")


def read_bar_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of bars per file; the symbol defaults to the file's stem and the amount to 0."""
    schema = "symbol string, date string, open double, high double, low double, close double, volume double, amount double"
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.coalesce("symbol", stem).alias("symbol"), F.to_date("date").alias("date"), "open", "high", "low", "close", "volume", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars as Parquet by year, sorted by symbol and date inside files."""
    year = bars.withColumn("year", F.year("date"))
    year.repartition("year", "symbol").sortWithinPartitions("symbol", "date").write.mode(mode).partitionBy("year").parquet(path)


def normalise_bars(bars: DataFrame) -> DataFrame:
    """Casts, and fills in missing high, low, volume and amount."""
    have = set(bars.columns)
    c = F.col("close").cast("double")
    get = lambda name, default: F.coalesce(F.col(name).cast("double"), default) if name in have else default
    return bars.select(
        F.col("symbol").cast("string").alias("symbol"), F.col("date").cast("date").alias("date"), get("open", c).alias("open"), get("high", c * 1.005).alias("high"),
        get("low", c * 0.995).alias("low"), c.alias("close"), get("volume", F.lit(1.0)).alias("volume"), get("amount", F.lit(0.0)).alias("amount"))


def validate_bars(bars: DataFrame, required: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    missing = [c for c in required if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    if bars.isEmpty():
        raise ValueError("there are no bars")
    return bars


def scan_range(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    return bars.where((F.col("symbol") == symbol) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def scan_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bars of the listed symbols; unknown ones are dropped."""
    return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], order: Column | None = None, rows: int | None = None) -> DataFrame:
    """Last write wins by key: delta over base, and inside the delta the row with the greatest ``order`` (without one, the greatest by its other columns in turn).

    With ``rows``, about the number of rows of both, the merge is dealt over tasks of bounded size.
    """
    rest = [c for c in delta.columns if c not in key]
    rank = order if order is not None else F.struct(*rest) if rest else F.lit(0)
    both = base.withColumn("__from", F.lit(0)).unionByName(delta.withColumn("__from", F.lit(1)))
    both = both if rows is None else dealt(both, rows, *key)
    w = Window.partitionBy(*key).orderBy(F.desc("__from"), rank.desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__from")


def insert_ignore(base: DataFrame, delta: DataFrame, key: list[str], rows: int | None = None) -> DataFrame:
    """First write wins by key; of rows of the delta with one key, the smallest by the other columns. ``rows`` as in ``upsert``."""
    rest = [c for c in delta.columns if c not in key]
    first = delta.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row")).select(*key, "__row.*") if rest else delta.distinct()
    known = base.select(*key)
    if rows is not None:
        first, known = dealt(first, rows, *key), dealt(known, rows, *key)
    return base.unionByName(first.join(known, key, "left_anti"))


def incremental(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of the delta behind the last date of the base."""
    last = base.agg(F.max("date").alias("last"))
    return delta.crossJoin(F.broadcast(last)).where("last is null or date > last").drop("last")


#: Column headers of Chinese vendors.
VENDOR_NAMES = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount"}


def from_vendor(rows: DataFrame, after: str | None = None) -> DataFrame:
    """Bars with Chinese headers as bars; rows up to the date ``after`` are left out."""
    named = rows.withColumnsRenamed(VENDOR_NAMES).withColumn("date", F.to_date("date"))
    return named if after is None else named.where(F.col("date") > F.lit(after).cast("date"))


def upsert_analysis(base: DataFrame, results: DataFrame, analyst: str, fields: list[str]) -> DataFrame:
    """Results stored as JSON by (analyst, symbol, date); a new result replaces the old one."""
    new = results.select(F.lit(analyst).alias("analyst"), "symbol", "date", F.to_json(F.struct(*fields)).alias("body"))
    return upsert(base, new, ["analyst", "symbol", "date"], F.col("body"))


def save_results(rows: DataFrame, trades: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and trades as CSV with header, the summary as JSON, in folders below a new path."""
    rows.write.option("header", True).csv(f"{path}/results")
    trades.write.option("header", True).csv(f"{path}/trades")
    summary.write.json(f"{path}/summary")


PAYLOAD = r"\{.*\}"


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Bars of JSONP bodies (symbol, body) that hold ``{"data": "YYYYMMDD,o,h,l,c[,v[,a]];..."}``; rows of under five fields are dropped."""
    data = F.from_json(F.regexp_extract("body", r"(?s)" + PAYLOAD, 0), "data string")["data"]
    f = F.col("f")
    number = lambda i, default=None: F.coalesce(F.try_element_at(f, F.lit(i)).try_cast("double"), F.lit(default)) if default is not None else F.try_element_at(f, F.lit(i)).try_cast("double")
    rows = payloads.select("symbol", F.explode(F.split(data, ";")).alias("line")).select("symbol", F.split("line", ",").alias("f")).where(F.size("f") >= 5)
    return rows.select(
        "symbol", F.try_to_date(F.col("f")[0], "yyyyMMdd").alias("date"), number(2).alias("open"), number(3).alias("high"), number(4).alias("low"),
        number(5).alias("close"), number(6, 0.0).alias("volume"), number(7, 0.0).alias("amount")).where("date is not null and close is not null")


STRICT_FIELDS = 6


def parse_strict(payloads: DataFrame) -> DataFrame:
    """Every line of JSONP bodies (symbol, body) as a bar, or with the ``reason`` why it is none.

    A bar needs six fields: a date, four prices and a whole volume; a seventh is the amount, 0 without it. ``symbol, date, open, high, low, close, volume, amount, line, reason``:
    ``reason`` is null for bars, else ``body`` (no data in it; the body is the line), ``fields``, ``date``, ``price``, ``volume`` or ``amount``, the first that applies. Blank lines are none.
    Callers keep both sides: ``where("reason is null")`` are the bars, the rest the quarantine.
    """
    data = F.from_json(F.regexp_extract("body", r"(?s)" + PAYLOAD, 0), "data string")["data"]
    lines = payloads.select("symbol", "body", data.alias("data")).select("symbol", F.col("data").isNull().alias("bare"), F.explode(F.when(F.col("data").isNull(), F.array("body")).otherwise(F.split("data", ";"))).alias("line"))
    lines = lines.where("bare or trim(line) <> ''").withColumn("f", F.split("line", ","))
    at = lambda i: F.try_element_at("f", F.lit(i))
    prices = {c: at(k).try_cast("double") for k, c in enumerate(("open", "high", "low", "close"), 2)}
    bad = lambda c: c.isNull() | F.isnan(c)
    volume, amount = F.when(at(6).rlike(r"^\s*[+-]?[0-9]+\s*$"), at(6).try_cast("double")), F.coalesce(at(7).try_cast("double"), F.lit(0.0))
    p = lines.select("symbol", "line", "bare", F.size("f").alias("n"), F.try_to_date(at(1), "yyyyMMdd").alias("date"), *[c.alias(n) for n, c in prices.items()], volume.alias("volume"), amount.alias("amount"), (at(7).isNotNull() & at(7).try_cast("double").isNull()).alias("no_amount"))
    reason = (
        F.when(F.col("bare"), "body").when(F.col("n") < STRICT_FIELDS, "fields").when(F.col("date").isNull(), "date").when(bad(F.col("open")) | bad(F.col("high")) | bad(F.col("low")) | bad(F.col("close")), "price")
        .when(F.col("volume").isNull(), "volume").when(F.col("no_amount"), "amount")
    )
    return p.select(*COLUMNS, "line", reason.alias("reason"))
