"""The monitor as a loop: a feed of packages, each fetched, audited and told of once, and a bounded store of their archives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import api
from larkspur.operators import model
from larkspur.operators.tables import cut
from larkspur.sinks import report
from larkspur.sources import scan
from larkspur.sources.files import file_system, write_bytes
from larkspur.streaming import alerts, state

#: Archives that the store keeps.
STORED = 500
#: Takes name, version and link of a package; gives a file name and the bytes, or None where there is no source archive.
Fetch = Callable[[str, str, str], tuple[str, bytes] | None]
FETCHED = "package_name string, version string, link string, package_file string, length long, content binary, error string"


def fetched(entries: DataFrame, fetch: Fetch) -> DataFrame:
    """Entries (package_name, version, link) with the archive that ``fetch`` gives where the rows are, or an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for entry in part.itertuples(index=False):  # one archive at a time
                name, data, error = None, None, None
                try:
                    found = fetch(entry.package_name, entry.version, entry.link)
                    name, data = found or (None, None)
                    error = None if found else "no source archive"
                except Exception as failure:  # any failure is the row's, not the job's
                    error = f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame([(*entry, name, None if data is None else len(data), data, error)], columns=["package_name", "version", "link", "package_file", "length", "content", "error"]).astype({"length": "Int64"})

    return entries.select("package_name", "version", "link").mapInPandas(run, FETCHED)


def package_results(archives: DataFrame, scorer: model.TreeModel | None = None) -> DataFrame:
    """File results of fetched archives, as ``alerts`` takes them.

    A package one of whose files cannot be analysed within its limits has the
    results of the others; an archive that cannot be read has no findings.
    """
    good = archives.where("content IS NOT NULL").withColumn("path", F.concat_ws("/", "package_name", "version", "package_file"))
    results = api.file_results(scan.expand(good.select("path", "length", "content")), scorer)
    results = report.annotated(results.withColumn("path", F.coalesce("archive_path", "file_path")))
    item = lambda x, note: F.struct(x["rule"].alias("rule"), report.level_name(x["confidence"]).alias("confidence"), x["label"].alias("label"), x["description"].alias("description"), note.alias("annotation"))
    results = results.select("path", "file_path", "archive_path", F.col("score").cast("double").alias("score"), F.zip_with("findings", "annotations", item).alias("items"))
    return good.select("package_name", "version", "link", "package_file", "path").join(results, "path").drop("path")


def store(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive (package_file, content) to ``folder``; gives the paths."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            paths = [f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}" for name in part["package_file"]]
            for path, data in zip(paths, part["content"]):
                write_bytes(path, data)
            yield pd.DataFrame({"path": paths})

    return archives.select("package_file", "content").mapInPandas(run, "path string")


def remove(files: DataFrame) -> DataFrame:
    """Deletes files (path); gives path and what went wrong, null where nothing did."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            errors = []
            for path in part["path"]:
                system, plain = file_system(path)
                try:
                    system.delete_file(plain)
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            yield pd.DataFrame({"path": part["path"], "error": errors})

    return files.select("path").mapInPandas(run, "path string, error string")


def enforce_quota(spark: SparkSession, folder: str, keep: int = STORED) -> DataFrame:
    """Deletes the oldest files of ``folder``, by time and then name, beyond the newest ``keep``; gives what ``remove`` gives."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(keep).select("path")
    return remove(files.join(newest, "path", "left_anti"))


def watch_feed(
    spark: SparkSession, entries: DataFrame, fetch: Fetch, sent_path: str, checkpoint: str, scorer: model.TreeModel | None = None, notify: Callable[[DataFrame], None] | None = None,
    archive_folder: str | None = None, keep: int = STORED, once: bool = False, package_hours: float | None = state.PACKAGE_HOURS, alert_hours: float | None = state.ALERT_HOURS,
) -> alerts.Monitor:
    """Over a stream of feed entries: each version of a package is fetched and audited once, each alert goes out once.

    Only archives of packages with an alert are stored, and of those the newest
    ``keep``.  Entries with an error are left out.  A batch that is run again
    after a failure fetches and audits its packages again; messages and files
    are replaced, not repeated.
    """
    folder = f"{checkpoint}/outbox"
    put = alerts.outbox(spark, folder)
    new = state.new_packages(entries.where("error IS NULL"), package_hours)

    def batch(rows: DataFrame, number: int) -> None:
        archives = cut(fetched(rows, fetch))  # fetched once, though read several times
        results = cut(package_results(archives, scorer))
        put(results, number)
        if archive_folder is not None:
            alerting = alerts.packages(results).where("alert").select("package_name", "version")
            store(archives.join(alerting, ["package_name", "version"], "left_semi"), archive_folder).collect()
            if alerting.take(1):
                enforce_quota(spark, archive_folder, keep).collect()

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/packages")
    with state.keyed_state(spark):
        first = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
    if once:
        first.awaitTermination()
    return alerts.Monitor(first, alerts.tell(spark, folder, sent_path, f"{checkpoint}/told", notify, once, alert_hours))
