"""Keyed state of the monitor: what was processed or told of already, for a time.

State lives in RocksDB with a time to live, so it is bounded by what arrives
within that time and not by the history of the monitor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Times to live: package versions, and alerts (after which a finding that is still there is told of again).
PACKAGE_HOURS, ALERT_HOURS = 24 * 90, 24 * 30


class First(StatefulProcessor):
    """Passes the first row of a key and no other until the key's time has passed."""

    def __init__(self, columns: list[str], hours: float | None):
        self.columns, self.ttl = columns, None if hours is None else max(1, int(hours * 3_600_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", **({} if self.ttl is None else {"ttlDurationMs": self.ttl}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        if not known:
            self.seen.update((True,))
        first = True
        for part in rows:  # all are read, a key's rows come in batches
            if first and not known and len(part):
                first = False
                yield part[self.columns].head(1)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings of queries with keyed state, for those that are started within; the session has its own again afterwards.

    A time to live needs the RocksDB store.  Batches without data are off: a
    query by processing time asks for one after each, so a run over what is
    available would never end.
    """
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def first_of(rows: DataFrame, keys: list[str], hours: float | None) -> DataFrame:
    """Of a stream's rows the first of each key, once within ``hours`` (None: once for ever).

    Rows of one key in one batch are one; which of them passes is not said, so
    keys should determine what matters.  Null is a key like any other.  On a
    table that is no stream, each key passes once.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    names = [f"_key{i}" for i in range(len(keys))]
    # a null key is told from the empty text by its tag
    keyed = rows.withColumns({n: F.to_json(F.struct(F.col(k).alias("k"))) for n, k in zip(names, keys)})
    return keyed.groupBy(*names).transformWithStateInPandas(First(rows.columns, hours), rows.schema, "Append", "ProcessingTime")


def new_packages(entries: DataFrame, hours: float | None = PACKAGE_HOURS) -> DataFrame:
    """Feed entries (package_name, version, ...), each version of a package once."""
    return first_of(entries, ["package_name", "version"], hours)


def new_alerts(messages: DataFrame, hours: float | None = ALERT_HOURS) -> DataFrame:
    """Messages (package_name, version, block, message), each block of a package once."""
    return first_of(messages, ["package_name", "block"], hours)


def windowed_counts(events: DataFrame, every: str, late: str, by: list[str], time: str = "ts") -> DataFrame:
    """Events by time window and columns: window_start, the columns, n; on a stream a window closes ``late`` after its end.

    Rows without a time are in no window.  A stream that has seen its end gives
    the rows of the table, but for events later than ``late``.
    """
    rows = events.where(F.col(time).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def start(out: DataFrame, path: str, checkpoint: str, once: bool, every: str = "5 minutes") -> StreamingQuery:
    """Writes a stream with keyed state as Parquet, each row once."""
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with keyed_state(out.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
