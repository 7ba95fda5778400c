"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset (single-machine tests)
    the checkpoint folder of the context or one under ``/tmp/checkpoints`` is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames made by ``written``, once all that was made from them has itself been written."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch that carries whole texts to Python.
TEXT_ROWS = 1000


def with_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, after seeing to it that the session sends at most TEXT_ROWS rows to Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def give_back_memory() -> None:
    """Returns what this Python worker has freed to the system, which it else keeps as long as it lives: Arrow's pool, and the heap where the C library can trim it."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_col: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null ids: null)."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % n
