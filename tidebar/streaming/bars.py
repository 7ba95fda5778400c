"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import upsert


def stream_bars(ticks: DataFrame, hours: int = 1, lateness: str = "2 hours") -> DataFrame:
    """Bars of a tick stream (symbol, ts, price, seq); ticks later than ``lateness`` are dropped."""
    at = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", f"{hours} hours").alias("w"))
    return g.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume"),
    ).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors share; a temporary one on a single machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes batch n of a stream to ``batch=n`` under ``path``; a replayed batch replaces itself, so the sink is idempotent."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


MANIFEST = "bucket int, version long, folder string"


def bucket_of(key: str, buckets: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).cast("int")


class BucketTable:
    """A keyed table in buckets of its first key column, changed by copy-on-write.

    ``data/v=N/bucket=K`` holds bucket K as version N left it, ``manifest/v=N`` says for every bucket which folder is current. A version is there once
    its manifest is; what a broken attempt has left is overwritten or never named. Folders that no kept manifest names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("symbol", "date"), buckets: int = 64, keep_versions: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep_versions = spark, path.rstrip("/"), key, buckets, keep_versions

    def files(self, path: str):
        """Hadoop's view of a path: its file system and the path, so that any shared store will do."""
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self.files(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        whole = [s.getPath() for s in fs.listStatus(p) if fs.exists(self.files(f"{s.getPath().toString()}/_SUCCESS")[1])]
        return sorted(int(x.getName()[2:]) for x in whole)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        found = self.versions()
        if not found:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={found[-1] if version is None else version}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, schema, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(self.manifest().items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Puts the rows of ``batch`` in as ``version``; buckets without a row of it are not touched, a version that is there already changes nothing."""
        found = self.versions()
        if found and version <= found[-1]:
            return
        current = self.manifest()
        come = batch.withColumn("bucket", bucket_of(self.key[0], self.buckets))
        touched = [r["bucket"] for r in come.select("bucket").distinct().collect()]
        base = self.read(batch.schema, touched)
        out = upsert(base, batch, list(self.key)).withColumn("bucket", bucket_of(self.key[0], self.buckets))
        out.repartition("bucket", *[F.col(k) for k in self.key]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        current |= {b: f"data/v={version}/bucket={b}" for b in touched}
        lines = [(b, int(f.split("v=")[1].split("/")[0]), f) for b, f in sorted(current.items())]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self.clean()

    def clean(self) -> None:
        """Drops manifests beyond the kept ones, and the folders that only they named."""
        found = self.versions()
        old, kept = found[: -self.keep_versions], found[-self.keep_versions :]
        named = {f for v in kept for f in self.manifest(v).values()}
        for v in old:
            for f in set(self.manifest(v).values()) - named:
                fs, p = self.files(f"{self.path}/{f}")
                fs.delete(p, True)
            fs, p = self.files(f"{self.path}/manifest/v={v}")
            fs.delete(p, True)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("symbol", "date"), buckets: int = 64):
    """Keyed upsert of a stream into a ``BucketTable``: batch n is its version n and rewrites the buckets of its own keys only.

    A batch that is replayed finds its version there and changes nothing, so the sink is idempotent.
    """

    def merge(batch: DataFrame, n: int) -> None:
        BucketTable(batch.sparkSession, path, key, buckets).merge(batch, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
