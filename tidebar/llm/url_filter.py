"""URL filters: sort-merge range join of urls with nested (host, path prefix) rules. DataFrame operations only.

Canonical keys. A rule's host is kept label-reversed (``org.example``) and a url is given one sort
key for each host suffix it has, so that "this host and all subdomains" becomes equality on the
reversed suffix. Behind it stands the path, and a path prefix ``p`` becomes the interval
``[p, p + 0xFF)`` of UTF-8 bytes (0xFF occurs in no UTF-8 text). Intervals of one host nest or are
disjoint.

Sweep. Rule starts, urls and rule ends are sorted together by (reversed suffix, key). A running
count of open intervals is the height of the stack; slot ``d`` of the stack is the last rule that
opened at height ``d``. The top of the stack at a url is its longest rule for that suffix. Slots
are window columns, so the sweep streams through a sorted partition and holds one row; their number
is the greatest nesting of the rules, a scalar computed from the rules alone.

Skew. A suffix with rules is dealt over salted partitions, each with its own copy of that suffix's rules. It gets
its share of the session's shuffle partitions: a suffix that half of the urls have (``com``) is swept by half of the
tasks, a rare one by one, so that rules are copied only where urls are many. Hosts without rules are dealt by row.
Rules are joined, never collected; the driver gets the greatest nesting and the number of pages.

Edge cases. Null urls and urls without ``://`` have empty host and path and match no rule. Rules
that repeat count once; if they disagree, ``block`` wins. The longest host wins, then the longest path.
An empty rule table gives every url the default verdict. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

ALLOW, BLOCK = "allow", "block"
START, POINT, END = 0, 1, 2


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a rule list given in code."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_url(url):
    """(host, path) columns: host A-Z lower-cased, both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(text, r"://([^/?#]*)([^?#]*)", 1))
    return host, F.regexp_extract(text, r"://([^/?#]*)([^?#]*)", 2)


def reversed_host(labels):
    return F.concat_ws(".", F.reverse(labels))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row per rule: reversed host, start key, rule struct; with the nesting height of each."""
    one = rules.groupBy("host", "path").agg(F.min(F.col("verdict") == ALLOW).alias("ok"))
    rule = F.struct(
        F.length("host").alias("host_len"), F.length("path").alias("path_len"),
        F.concat("host", "path").alias("rule"), F.when(F.col("ok"), ALLOW).otherwise(BLOCK).alias("verdict"),
    )
    return one.select(reversed_host(F.split("host", r"\.")).alias("rhost"), F.col("path").cast("binary").alias("key"), rule.alias("rule"))


def edges(rules: DataFrame) -> DataFrame:
    """A start and an end row for each rule."""
    end = F.concat("key", F.unhex(F.lit("FF")))
    return rules.select("rhost", "rule", F.inline(F.array(
        F.struct(F.col("key").alias("at"), F.lit(START).alias("kind")), F.struct(end.alias("at"), F.lit(END).alias("kind")))))


def with_height(events: DataFrame, *by: str) -> tuple[DataFrame, Window]:
    w = Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    return events.withColumn("height", F.sum(step).over(w)), w


def shares(points: DataFrame, rules: DataFrame, rows: int) -> DataFrame:
    """Of each suffix with rules (``rhost``) the number of salted partitions for its urls (``salts``)."""
    ruled = rules.select("rhost").distinct()
    counted = points.select("rhost").join(ruled, "rhost").groupBy("rhost").agg(F.count("*").alias("n"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.coalesce("n", F.lit(0)) * tasks / max(1, rows))
    return ruled.join(counted, "rhost", "left").select("rhost", F.greatest(salts, F.lit(1)).cast("long").alias("salts"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = ALLOW) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` (rule null and the default verdict if none fits)."""
    canonical = canonical_rules(rules)
    top = with_height(edges(canonical), "rhost")[0].agg(F.max("height")).first()[0] or 0
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not top:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: reversed_host(F.slice(labels, i, F.size(labels))))
    points = urls.select("*", F.posexplode(suffixes).alias("nth", "rhost"))
    dealt = written(shares(points, canonical, pages.count()), "url-shares")
    points = (
        points.join(dealt, "rhost", "left").where("salts is not null or nth = 0")  # the whole host stays in any case, so that no url is lost
        .select("rhost", F.coalesce(F.pmod(F.xxhash64("row"), "salts"), F.xxhash64("row")).alias("salt"), F.col("path").cast("binary").alias("at"),
                F.lit(POINT).alias("kind"), "row", "page_id", "host", "path")
    )
    copies = edges(canonical).join(dealt, "rhost").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    swept, w = with_height(points.unionByName(copies, allowMissingColumns=True), "rhost", "salt")
    opened = lambda d: F.last(F.when((F.col("kind") == START) & (F.col("height") == d), F.col("rule")), ignorenulls=True).over(w)
    stack = swept.select("*", *[opened(d).alias(f"slot{d}") for d in range(1, top + 1)])
    current = F.coalesce(*[F.when(F.col("height") == d, F.col(f"slot{d}")) for d in range(1, top + 1)])
    best = (
        stack.where(F.col("kind") == POINT).select("row", "page_id", "host", "path", current.alias("rule"))
        .groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("rule").alias("best"))
    )
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
