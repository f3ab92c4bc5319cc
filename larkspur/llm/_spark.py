"""Helpers that all operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the Arrow batches that go to Python and back; one longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a local session (one process, so
    one file system) uses a folder below its warehouse; any other raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
    return sc.getCheckpointDir()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, each with as many underscores as set it apart from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(*columns: str) -> list[Column]:
    """Two longs that identify a row's content; never null.

    Rows that repeat an id with other texts have other keys; rows that repeat
    both share one, and every operator gives such rows the same result.
    """
    return [F.xxhash64(*columns).alias("_k1"), F.crc32(F.concat_ws("\x00", *[F.col(c).cast("string") for c in columns])).alias("_k2")]


def partitions_for(total: float, each: float, least: int = 1) -> int:
    """How many partitions hold ``total`` units at ``each`` units."""
    return max(least, int(-(-total // each)))


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``, where it has no size of its own.

    By default a batch has 10,000 rows or 64 MB, which the executor and its
    worker hold several times over, whatever is done with them in chunks.
    """
    if spark.conf.get(_BATCH_SETTING) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory to the system; a worker keeps it for its next task otherwise, while the JVM needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on batches of bounded bytes; a worker gives back its memory after each task."""
    bounded_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)
