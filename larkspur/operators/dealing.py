"""How rows that are much work, though they are few bytes, get to tasks and through Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks for each core of the cluster; rows that a worker has as Python objects at a time.
TASKS, ROWS = 4, 256


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, dealt evenly over tasks for all cores.

    Spark cuts files into tasks by their bytes, so that a few megabytes of
    rows, hours of work, would be one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ``ROWS`` at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)
