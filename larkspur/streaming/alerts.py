"""Alerts of the package monitor: which file results to tell of, and in what words.

Everything is a plan over file results, one row a file: package_name, version,
link, package_file, file_path, archive_path, score and items, an array of
struct(rule, confidence, label, description, annotation) with levels by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.streaming import state

# Levels, thresholds, sizes of messages, and fragments of paths that are left out.
HIGH_LEVELS, TOP_LEVEL = ["high", "very_high"], "very_high"
SCORE_MORE_THAN, TOP_LEVEL_SCORE = 0.7, 0.401
MESSAGE_CHARS, ANNOTATION_CHARS, RULES_SHOWN, ANNOTATIONS_SHOWN, ITEMS_SHOWN = 4096, 1200, 10, 3, 5
EXCLUDED_PATHS = ["lib/site-packages/pip/_vendor/pkg_resources/__init__.py", "lib/site-packages/pkg_resources/__init__.py", "tests/", "test_"]

_PACKAGE = ["package_name", "version", "link", "package_file"]
_LEAST_FILE = len("\n\n (ML score: 0.0000)")
MESSAGE = "package_name string, version string, block string, message string"


def excluded_path(path: Column, archive: Column) -> Column:
    """Whether either path, in lower case and with slashes, holds an excluded fragment."""
    out = F.lit(False)
    for x in (path, archive):
        plain = F.lower(F.replace(x, F.lit("\\"), F.lit("/")))
        for fragment in EXCLUDED_PATHS:
            out |= F.coalesce(F.contains(plain, F.lit(fragment)), F.lit(False))
    return out


def of_levels(items: Column, levels: list[str]) -> Column:
    """The items of these levels."""
    return F.filter(items, lambda x: F.lower(x["confidence"]).isin(levels))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def decided(results: DataFrame) -> DataFrame:
    """The results that are not excluded, with ``top_items`` and whether the file's score is high."""
    kept = results.where(~excluded_path(F.col("file_path"), F.col("archive_path")))
    top = F.when(F.col("score") >= TOP_LEVEL_SCORE, of_levels(F.col("items"), [TOP_LEVEL])).otherwise(F.slice("items", 1, 0))
    return kept.withColumns({"top_items": top, "high_score": F.coalesce(F.col("score") > SCORE_MORE_THAN, F.lit(False))})


def packages(results: DataFrame) -> DataFrame:
    """A row for each package: files, excluded files, files of a high score, top items, and whether to alert.

    A package's files are folded by the partial sums of the aggregate; of its
    items only those that a message can show are kept.
    """
    marked = results.withColumn("out", excluded_path(F.col("file_path"), F.col("archive_path")))
    top = F.when(~F.col("out") & (F.col("score") >= TOP_LEVEL_SCORE), F.size(of_levels(F.col("items"), [TOP_LEVEL]))).otherwise(0)
    out = marked.groupBy(*_PACKAGE).agg(
        F.count("*").alias("files"),
        F.count_if("out").alias("excluded"),
        F.count_if(~F.col("out") & (F.col("score") > SCORE_MORE_THAN)).alias("high_scores"),
        F.sum(top).alias("top_findings"),
    )
    return out.withColumn("alert", (F.col("top_findings") > 0) | (F.col("high_scores") > 0))


def _foremost(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The first n rows of each package; a package of any size is ranked before its rows come together."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*_PACKAGE).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def annotation_block(annotations: Column) -> Column:
    """The first annotations, each cut to size, with rules between them."""
    shown = F.transform(F.slice(annotations, 1, ANNOTATIONS_SHOWN), lambda a: shortened(F.trim(F.replace(a, F.lit("\r\n"), F.lit("\n"))), ANNOTATION_CHARS))
    return F.when(F.size(shown) > 0, F.array_join(shown, "\n\n---\n\n")).otherwise("No annotation details available")


def finding_messages(results: DataFrame) -> DataFrame:
    """package_name, version, block and message for each package with top findings."""
    each = decided(results).where(F.size("top_items") > 0).select(*_PACKAGE, "file_path", F.posexplode("top_items").alias("i", "x"))
    # distinct rules and annotations with their first places, of which a package keeps those that its message shows
    rules = each.groupBy(*_PACKAGE, F.concat("x.rule", F.lit(" ("), "x.confidence", F.lit(")")).alias("rule")).agg(F.min(F.struct("file_path", "i")).alias("at"), F.count("*").alias("n"))
    total = rules.groupBy(*_PACKAGE).agg(F.sum("n").alias("n"))
    rules = _foremost(rules, F.col("at"), RULES_SHOWN).groupBy(*_PACKAGE).agg(F.array_sort(F.collect_list(F.struct("at", "rule"))).alias("rules"))
    notes = each.where(F.trim("x.annotation") != "").groupBy(*_PACKAGE, F.trim("x.annotation").alias("note")).agg(F.min(F.struct("file_path", "i")).alias("at"))
    notes = _foremost(notes, F.col("at"), ANNOTATIONS_SHOWN).withColumn("note", F.left("note", F.lit(ANNOTATION_CHARS + 4)))
    notes = notes.groupBy(*_PACKAGE).agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("notes"))
    both = total.join(rules, _PACKAGE).join(notes, _PACKAGE, "left")
    block = annotation_block(F.coalesce(F.transform("notes", lambda x: x["note"]), F.array().cast("array<string>")))
    listed = F.array_join(F.transform(F.slice("rules", 1, RULES_SHOWN), lambda x: F.concat(F.lit("- "), x["rule"])), "\n")
    text = F.concat(
        F.lit("High-confidence match detected\nPackage: "), "package_name", F.lit(" "), "version", F.lit("\nLink: "), "link", F.lit("\nFile: "), "package_file",
        F.lit("\nVery-high findings: "), F.col("n").cast("string"), F.lit("\nRules:\n"), listed, F.lit("\n\nAnnotated code:\n"), block,
    )
    return both.select("package_name", "version", block.alias("block"), shortened(text, MESSAGE_CHARS).alias("message"))


def score_messages(results: DataFrame) -> DataFrame:
    """package_name, version, block (a constant) and message for each package with files of a high score, best first."""
    high = decided(results).where("high_score")
    items = F.transform(F.slice("items", 1, ITEMS_SHOWN), lambda x: F.concat(F.lit("  - "), x["rule"], F.lit(" ("), x["confidence"], F.lit(") - "), x["description"]))
    more = F.when(F.size("items") > ITEMS_SHOWN, F.array(F.concat(F.lit("  ... and "), (F.size("items") - ITEMS_SHOWN).cast("string"), F.lit(" more findings")))).otherwise(F.array().cast("array<string>"))
    head = F.concat("file_path", F.lit(" (ML score: "), F.format_string("%.4f", "score"), F.lit(")"))
    lines = high.select(*_PACKAGE, F.struct((-F.col("score")).alias("s"), "file_path", F.concat(F.lit("\n"), F.array_join(F.concat(F.array(head), items, more), "\n")).alias("text")).alias("x"))
    # a file takes at least as many characters as its empty head, so those beyond would be cut off anyway
    shown = _foremost(lines, F.col("x"), MESSAGE_CHARS // _LEAST_FILE + 1)
    by = lines.groupBy(*_PACKAGE).agg(F.count("*").alias("n")).join(shown.groupBy(*_PACKAGE).agg(F.array_sort(F.collect_list("x")).alias("xs")), _PACKAGE)
    text = F.concat(
        F.lit("High score file detected\nPackage: "), "package_name", F.lit(" "), "version", F.lit("\nLink: "), "link", F.lit("\nFile: "), "package_file",
        F.lit(f"\nFiles exceeding score {SCORE_MORE_THAN}: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n"),
    )
    return by.select("package_name", "version", F.lit("__score__").alias("block"), shortened(text, MESSAGE_CHARS).alias("message"))


def messages(results: DataFrame) -> DataFrame:
    """All messages, one for each package and block."""
    every = finding_messages(results).unionByName(score_messages(results)).groupBy("package_name", "block").agg(F.min(F.struct("version", "message")).alias("m"))
    return every.select("package_name", "m.version", "block", "m.message")


class Monitor:
    """The queries of a running monitor, each fed by the one before."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self, seconds: float | None = None) -> None:
        for query in self.queries:
            query.awaitTermination(seconds) if seconds else query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def outbox(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A step of a stream of file results: the messages of a batch, in a folder of its own, which a batch that is run again replaces."""
    spark.createDataFrame([], MESSAGE).write.mode("ignore").parquet(f"{folder}/batch=-1")
    return lambda rows, number: messages(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def tell(spark: SparkSession, folder: str, sent_path: str, checkpoint: str, notify: Callable[[DataFrame], None] | None = None, once: bool = False, hours: float | None = state.ALERT_HOURS) -> StreamingQuery:
    """Over the messages in ``folder``: what was not told within ``hours`` is appended to ``sent_path`` and passed to ``notify``.

    The table has each message once.  ``notify`` is called once a batch, and
    again where a batch is run again after a failure.
    """
    spark.createDataFrame([], MESSAGE).write.mode("ignore").parquet(f"{sent_path}/batch=-1")
    new = state.new_alerts(spark.readStream.schema(MESSAGE).parquet(folder), hours)

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{sent_path}/batch={number}"
        rows.select("package_name", "version", "block", "message").write.mode("overwrite").parquet(path)
        if notify is not None:
            notify(spark.read.schema(MESSAGE).parquet(path))

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    with state.keyed_state(spark):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def monitor(spark: SparkSession, results: DataFrame, sent_path: str, checkpoint: str, notify: Callable[[DataFrame], None] | None = None, once: bool = False, hours: float | None = state.ALERT_HOURS) -> Monitor:
    """Runs over a stream of file results: each batch's messages go to an outbox, and from there out, each once within ``hours``.

    Which input is done and what was told stand in the checkpoints, so neither
    a restart nor a copy of a package under another version alerts twice.  What
    was told is keyed state with a time to live, not the history of the table.
    """
    folder = f"{checkpoint}/outbox"
    writer = results.writeStream.foreachBatch(outbox(spark, folder)).option("checkpointLocation", f"{checkpoint}/messages")
    first = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
    if once:
        first.awaitTermination()
    return Monitor(first, tell(spark, folder, sent_path, f"{checkpoint}/told", notify, once, hours))
