"""Labelled datasets of sources in JSON lines, package lists and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.features import features
from larkspur.operators.rules import with_facts, with_findings
from larkspur.sinks.report import level_name

_ENTRY = "archive string, file string, reason string, code string, verdict string, lines string, _bad string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines, gzipped or not; lines that cannot be read keep their text in ``_bad``, and ``_line`` is an entry's place in the dataset."""
    rows = spark.read.schema(_ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # within a part of a file rows are numbered as they are read
    return rows.withColumn("_line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def decoded(entries: DataFrame) -> DataFrame:
    """Entries with ``content``, their code in text, and ``error``: what is wrong with a line or its code, else null."""
    raw = F.when(T.is_base64(F.trim("code")), F.expr("try_to_binary(trim(code), 'base64')"))
    text = raw.cast("string")
    rows = entries.withColumn("_raw", raw).withColumn("content", F.when(F.is_valid_utf8(text), text))
    error = (
        F.when(F.col("_bad").isNotNull() | F.col("file").isNull() | F.col("code").isNull() | F.col("verdict").isNull(), "line not read")
        .when(F.col("_raw").isNull(), "code is not base64")
        .when(F.col("content").isNull(), "code is not UTF-8")
    )
    return rows.withColumn("error", error).drop("_raw", "_bad")


def code_of(entries: DataFrame, file: str) -> DataFrame:
    """``content`` of an entry with this file name: the first in the dataset, or in the order of archives where entries have no place; one row or none."""
    order = ["_line"] if "_line" in entries.columns else ["archive", "content"]
    return decoded(entries).where((F.col("file") == file) & F.col("error").isNull()).orderBy(*order).limit(1).select("content")


def _as_sources(entries: DataFrame) -> DataFrame:
    """Entries that can be read, as sources."""
    good = decoded(entries).where("error IS NULL")
    return good.select(F.sha2(F.concat_ws("\0", "archive", "file"), 256).alias("file_id"), F.col("archive").alias("archive_path"), F.col("file").alias("file_path"), "content", "verdict")


def feature_lines(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON text for each entry that can be read: its features, ``_label`` and ``_file_path``; ``limit`` counts such entries."""
    rows = _as_sources(entries)
    rows = rows if limit is None else rows.orderBy("file_path", "file_id").limit(limit)
    made = features(rows)
    made = made if limit is None else made.orderBy("file_path", "file_id")
    flat = F.to_json("features")
    tail = F.to_json(F.struct(F.col("verdict").alias("_label"), F.col("file_path").alias("_file_path")))
    return made.select(F.concat(F.substr(flat, F.lit(1), F.length(flat) - 1), F.lit(","), F.substr(tail, F.lit(2))).alias("value"))


def validation(entries: DataFrame, least: int = 1, no_rules: bool = False, with_code: bool = False) -> DataFrame:
    """One JSON text for each malicious entry: file, rules and perhaps code; with ``no_rules`` only those without a finding."""
    rows = with_findings(with_facts(_as_sources(entries).where("verdict = 'malicious'")))
    kept = F.filter("findings", lambda x: x["confidence"] >= least)
    rows = rows.withColumn("kept", kept)
    rows = rows.where(F.size("kept") == 0) if no_rules else rows
    rules = F.transform("kept", lambda x: F.struct(x["rule"].alias("code"), x["label"].alias("label"), x["description"].alias("description"), level_name(x["confidence"]).alias("confidence")))
    fields = [F.col("file_path").alias("file"), rules.alias("rules"), *([F.col("content").alias("code")] if with_code else [])]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def package_dump(sources: DataFrame, part: str | None = None) -> DataFrame:
    """archive_path, file_path and the marked text of archive members, whose path holds ``part`` where given."""
    rows = sources.where("archive_path IS NOT NULL AND content IS NOT NULL")
    rows = rows if part is None else rows.where(F.contains("file_path", F.lit(part)))
    return rows.select("archive_path", "file_path", F.concat(F.lit("=== "), F.col("file_path"), F.lit(" ===\n"), F.col("content"), F.lit("\n")).alias("value"))


def dump_new(packages: DataFrame, sources: DataFrame, done: DataFrame) -> DataFrame:
    """``package_dump`` of the listed packages (archive_path) that are not in ``done`` yet (archive_path)."""
    wanted = packages.select("archive_path").distinct().join(done.select("archive_path").distinct(), "archive_path", "left_anti")
    return package_dump(sources.join(wanted, "archive_path", "left_semi"))


def recent_packages(packages: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """name and path of source packages (name, path, upload_time, python_version) of the last days."""
    since = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))
    return packages.where((F.col("upload_time") >= since) & (F.col("python_version") == "source")).select("name", "path")


def downloads(packages: DataFrame, done: DataFrame, fetch=None) -> DataFrame:
    """name, path, and ``content`` or ``error`` of the packages (name, path) not in ``done`` (path).

    ``fetch(path) -> bytes`` runs where the rows are; without it the packages
    are only listed.  A failed fetch leaves nothing behind but its error.
    """
    new = packages.select("name", "path").join(done.select("path").distinct(), "path", "left_anti").select("name", "path")
    if fetch is None:
        return new.select("name", "path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))

    def run(batches):
        import pandas as pd

        for rows in batches:
            got = []
            for path in rows["path"]:
                try:
                    got.append((fetch(path), None))
                except Exception as error:  # any failure is the row's, not the job's
                    got.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame({"name": rows["name"], "path": rows["path"], "content": [c for c, _ in got], "error": [e for _, e in got]})

    return new.mapInPandas(run, "name string, path string, content binary, error string")


def feed_entries(feeds: DataFrame) -> DataFrame:
    """package_name, version, link and pub_date of the items in feeds (column xml); titles without a version are left out."""
    at = lambda tag: F.xpath("xml", F.lit(f"rss/channel/item/{tag}/text()"))
    items = feeds.select(F.explode(F.arrays_zip(at("title").alias("title"), at("link").alias("link"), at("pubDate").alias("pub_date"))).alias("x")).select("x.*")
    title = F.trim("title")
    return items.select(
        F.regexp_extract(title, r"^(.*\S)\s+(\S+)$", 1).alias("package_name"), F.regexp_extract(title, r"^(.*\S)\s+(\S+)$", 2).alias("version"), F.trim("link").alias("link"), F.trim("pub_date").alias("pub_date")
    ).where("package_name <> '' AND version <> ''")


def sdist_url(answer: Column) -> Column:
    """The url of the first source archive in a package's JSON description; null for none."""
    urls = F.from_json(answer, "struct<urls:array<struct<packagetype:string,url:string>>>")["urls"]
    return F.get(F.filter(urls, lambda u: u["packagetype"] == "sdist"), 0)["url"]


def over_quota(files: DataFrame, keep: int = 500) -> DataFrame:
    """The rows of ``files`` (name, mtime, ...) beyond the newest ``keep``, by time and then name."""
    newest = files.orderBy(F.desc("mtime"), F.desc("name")).limit(keep).select("name", "mtime")
    return files.join(newest, ["name", "mtime"], "left_anti").select(files.columns)
