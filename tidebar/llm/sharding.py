"""Shards of near equal bytes by sampled splitters over a range of keys.

Keys. A record's key is 40 bits of its text's digest followed by 20 bits of its id's digest, so equal texts are neighbours
and their copies have an order of their own. Records are ordered by key, id and checksum of the text.

Splitters. Keys are drawn with a chance by size (half of it by bytes, half by rows, so that neither large nor very many small
records overfill a range); quantiles of the sample, taken by Spark's quantile sketch, cut the keys into ranges. Each range is measured; a range
that holds over ``OVERFULL`` times its share is sampled again and subdivided: first between texts, and where one text alone fills it, between
its copies. Only splitters (one per ``RANGE_ROWS`` records beyond 1,024) and one line per range come to the driver.

Shards. With the ranges' exact bytes in front of each, a record's place in the whole order is known from its range alone. Shard k
takes what has its middle in the k-th equal part of all bytes. Copies of a text stay together as long as their bytes are at most
``1 / GROUP_PARTS`` of a shard; larger groups are cut between records. So two shards differ by at most two such parts or one
record, whichever is more, and the result does not depend on the sample.

Edge cases. Null texts count as empty, of size 1; null ids stand before others. Fully equal records are interchangeable: which of
them has which slot is open, the set of slots is not; they fall into one range. Other columns are ignored; an empty table gives no rows. Fewer
records than shards leave shards empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

ID_BITS = 20
#: Ranges are as many as records allow at RANGE_ROWS each, or LEAST_RANGES where LEAST_ROWS records are left for each.
LEAST_RANGES, LEAST_ROWS, RANGE_ROWS = 1024, 32, 500_000
#: Sampled keys per range, how many shares a range may hold, and into how many pieces an overfull one is cut per round.
RANGE_SAMPLES, OVERFULL, PIECES = 16, 4, 16
#: Groups of equal texts up to this part of a shard stay together.
GROUP_PARTS = 128
#: Subdivisions after which the ranges must do.
MOST_ROUNDS = 12
ORDER = ["key", "doc_id", "text_crc32"]


def key_columns(id_col: str, text_col: str) -> dict[str, Column]:
    """The columns of a record's place in the order, and its size."""
    text, doc_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    digits = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")
    key = F.shiftleft(digits(text, 10), ID_BITS) + digits(F.coalesce(doc_id.cast("string"), F.lit("")), ID_BITS // 4)
    return {"doc_id": doc_id, "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text), "key": key}


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, key``: all that deciding needs, some forty bytes a record."""
    return docs.select(*[c.alias(n) for n, c in key_columns(id_col, text_col).items()])


def in_range(splitters: list[int]) -> Column:
    """Number of the key's range; a splitter is the first key of its range."""
    edges = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), side="right"), dtype="int32")

    return number("key")


def sampled(df: DataFrame, load: Column, samples: int, pieces: int, seed: int) -> DataFrame:
    """Per ``part`` quantiles (``cut``) of keys drawn with ``load * samples`` expected draws each."""
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    drawn = df.select("part", "key", F.floor(load * samples + chance).cast("int").alias("n")).where("n > 0").select("part", "key", F.explode(F.sequence(F.lit(1), "n")))
    return drawn.groupBy("part").agg(F.percentile_approx("key", [k / pieces for k in range(1, pieces)], max(10_000, 8 * pieces)).alias("cut"))


def split_ranges(rows: DataFrame, total: int, count: int) -> tuple[list[int], pd.DataFrame]:
    """Splitters and one line per range: ``part, bytes, n, low, high``."""
    parts = max(2, min(LEAST_RANGES, count // LEAST_ROWS), count // RANGE_ROWS)
    load = F.col("size") / (2.0 * total) + 1 / (2.0 * count)
    whole = lambda keys: {k >> ID_BITS << ID_BITS for k in keys}  # noqa: E731  (cuts between texts)
    splitters = {k for r in sampled(rows.withColumn("part", F.lit(0)), load, parts * RANGE_SAMPLES, parts, 0).collect() for k in whole(r["cut"])}
    for turn in range(1, MOST_ROUNDS + 1):
        cut = sorted(splitters)
        ranged = rows.withColumn("part", in_range(cut))
        lines = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas()
        share = lines["bytes"] / (2.0 * total) + lines["n"] / (2.0 * count)
        over = lines[(share * parts > OVERFULL) & (lines["low"] < lines["high"])].set_index("part")
        if over.empty:
            break
        for r in sampled(ranged.where(F.col("part").isin(over.index.tolist())), load, parts * RANGE_SAMPLES * OVERFULL, PIECES, turn).collect():
            low, high, found = int(over.low[r["part"]]), int(over.high[r["part"]]), r["cut"]
            if low >> ID_BITS == high >> ID_BITS:
                splitters |= {k for k in found if low < k}
            else:
                # Both edges of a drawn text, so that a text which fills a range stands alone in the next round.
                splitters |= whole(found) | {k + (1 << ID_BITS) for k in whole(found)}
        if len(splitters) == len(cut):
            break
    return cut, lines.sort_values("part").reset_index(drop=True)


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record ``doc_id, size, text_crc32, key, shard, slot``: slots count a shard's records from 0 in the order of keys."""
    spark = docs.sparkSession
    rows = written(records(docs, id_col, text_col), "sizes")
    total, count = rows.agg(F.sum("size"), F.count("*")).head()
    if not count:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cut, lines = split_ranges(rows, total, count)
    lines["bytes_before"], lines["rows_before"] = lines["bytes"].cumsum() - lines["bytes"], lines["n"].cumsum() - lines["n"]
    # A text whose copies lie in several ranges: its bytes and where it begins, from the ranges' lines.
    lines["text"] = np.where(lines["low"] // 2**ID_BITS == lines["high"] // 2**ID_BITS, lines["low"] // 2**ID_BITS, -1)
    spread = lines[lines["text"] >= 0].groupby("text").agg(parts=("n", "size"), b=("bytes", "sum"), s=("bytes_before", "min"))
    lines = lines.join(spread[spread["parts"] > 1][["b", "s"]], on="text")
    starts = [(int(x.part), int(x.bytes_before), int(x.rows_before), *((None, None) if pd.isna(x.b) else (int(x.b), int(x.s)))) for x in lines.itertuples()]
    starts = spark.createDataFrame(starts, "part int, bytes_before long, rows_before long, spread_bytes long, spread_start long")
    ordered, text = Window.partitionBy("part").orderBy(*ORDER), F.shiftright("key", ID_BITS)
    group = Window.partitionBy("part", text)
    at = rows.withColumn("part", in_range(cut)).join(F.broadcast(starts), "part")
    at = at.withColumn("end", F.col("bytes_before") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.col("rows_before") + F.row_number().over(ordered) - 1)
    at = at.withColumn("group_bytes", F.coalesce("spread_bytes", F.sum("size").over(group))).withColumn("group_start", F.coalesce("spread_start", F.min(F.col("end") - F.col("size")).over(group)))
    twice = F.when(F.col("group_bytes") * shards * GROUP_PARTS <= total, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size"))
    shard = F.least(F.floor(F.expr("cast(twice as decimal(20, 0))") * shards / (2 * total)), F.lit(shards - 1)).cast("int")
    at = written(at.withColumn("twice", twice).select("doc_id", "size", "text_crc32", "key", "row", shard.alias("shard")), "places")
    discard(rows)
    first = at.groupBy("shard").agg(F.min("row").alias("first"))
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("row") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every record; the law is ``bytes``, which has no grown shard."""
    placed = place(docs, shards, id_col, text_col)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 1_000_000) -> None:
    """Writes the whole records to ``path/shard=K``, in files of at most ``file_rows`` rows.

    Each record is compared with the first key of every shard, so nothing is joined to the texts; fully equal records at a
    shard's border all go to the same side.
    """
    placed = place(docs, shards, id_col, text_col)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min(F.struct(*ORDER)).alias("first")).collect()}
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("record"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = own.select("record", *[c.alias(n) for n, c in key_columns("doc_id", "text").items()])
    here = F.struct(*ORDER)
    number = [F.when(here >= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, first[s])]), F.lit(s)) for s in sorted(first, reverse=True)]
    out = keyed.select("record.*", F.coalesce(*number, F.lit(min(first, default=0))).alias("shard"))
    out.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
