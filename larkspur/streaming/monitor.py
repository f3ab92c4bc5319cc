"""Watches a landing folder and writes the findings of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.rules import audit, chosen
from larkspur.sources.scan import expand

_FILES = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, least: int = 4, once: bool = False) -> StreamingQuery:
    """Findings of at least a confidence, as Parquet; the checkpoint remembers which files are done."""
    found = chosen(audit(expand(landing(spark, path).where(r"path rlike '(?i)[.](py|zip|tar[.]gz)$'"))), least)
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
