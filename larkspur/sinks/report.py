"""Reports of findings: previews, diagnostics, JSON lines, annotated files and tables.

Texts are made where the rows are, in Arrow batches; only what a person reads
at a terminal comes to the driver, row by row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.operators.tables import cut
from larkspur.sources.files import write_bytes

#: How levels are written in diagnostics.
SHOWN = {1: "VeryLow", 2: "Low", 3: "Medium", 4: "High", 5: "VeryHigh"}
HELP = {code: text for code, _, _, text in C.RULES}


def display_path(path: str | None, archive: str | None) -> str:
    return f"{archive}:{path}" if archive else path or ""


def level_name(confidence: Column) -> Column:
    """A level's name as written in JSON, such as ``very_high``."""
    out = F.lit(None).cast("string")
    for name, level in C.LEVELS.items():
        out = F.when(confidence == level, name).otherwise(out)
    return out


class Source:
    """A text with the places of its lines, in UTF-8 bytes."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "replace")
        self.starts = [0]
        at = self.data.find(b"\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = self.data.find(b"\n", at + 1)

    def __len__(self) -> int:
        return len(self.starts)

    def line(self, i: int) -> str:
        end = self.starts[i + 1] - 1 if i + 1 < len(self.starts) else len(self.data)
        return self.data[self.starts[i] : end].decode("utf-8", "replace")

    def line_of(self, at: int) -> int:
        """Number, from 0, of the line that holds a byte."""
        return bisect_right(self.starts, min(at, len(self.data))) - 1

    def column_of(self, at: int) -> int:
        """Characters before a byte in its line."""
        at = min(at, len(self.data))
        return len(self.data[self.starts[self.line_of(at)] : at].decode("utf-8", "replace"))


def preview(path: str, archive: str | None, code: str, confidence: int, text: str, start: int, end: int, context: int = 2) -> str:
    """The lines around a finding under a header; lines that it covers are marked with ``>``."""
    src = Source(text)
    start, end = min(start, len(src.data)), min(end, len(src.data))
    first, last = src.line_of(start), src.line_of(end)
    out = [f"{display_path(path, archive)}:{start}-{end} [{code} {SHOWN[confidence]}]"]
    for i in range(max(first - context, 0), min(last + 1 + context, len(src) - 1) + 1):
        out.append(f"{'>' if first <= i <= last else ' '} {i + 1:4} | {src.line(i)}")
    return "\n".join(out) + "\n"


_BOLD, _RED, _BLUE, _PLAIN = "\x1b[1m", "\x1b[31m", "\x1b[34m", "\x1b[0m"


def diagnostic(path: str, archive: str | None, text: str, labels: list[tuple[int, int, str]], title: str = "", code: str = "", notes: list[str] = (), colored: bool = False, context: int = 3) -> str:
    """A warning with the source lines of its labels (start, end, message), a caret line below each, and notes."""
    paint = lambda colour, x: f"{colour}{x}{_PLAIN}" if colored else x
    src = Source(text)
    labels = sorted(labels)
    wanted: set[int] = set()
    under: dict[int, list[tuple[int, int, str]]] = {}
    for start, end, message in labels:
        a, b = src.line_of(start), src.line_of(max(start, end - 1))
        wanted.update(range(max(a - context, 0), min(b + context, len(src) - 1) + 1))
        for i in range(a, b + 1):
            lo = src.column_of(start) if i == a else 0
            hi = src.column_of(end) if i == b else len(src.line(i))
            under.setdefault(i, []).append((lo, max(hi - lo, 1), message if i == b else ""))
    width = len(str(max(wanted, default=0) + 1))
    head = f"warning[{code}]" if code else "warning"
    at = labels[0][0] if labels else 0
    out = [paint(_BOLD, f"{head}: {title}" if title else head), f"{' ' * width} ┌─ {display_path(path, archive)}:{src.line_of(at) + 1}:{src.column_of(at) + 1}", f"{' ' * width} │"]
    before = None
    for i in sorted(wanted):
        if before is not None and i > before + 1:
            out.append(f"{' ' * width} ·")
        out.append(f"{paint(_BLUE, f'{i + 1:>{width}}')} │ {src.line(i)}")
        for lo, n, message in under.get(i, []):
            out.append(f"{' ' * width} │ {' ' * lo}{paint(_RED, ('^' * n + ' ' + message).rstrip())}")
        before = i
    out.append(f"{' ' * width} │")
    out += [f"{' ' * width} = {line}" for note in notes for line in note.splitlines()]
    return "\n".join(out) + "\n"


def finding_diagnostic(row: dict, item: dict, colored: bool = False) -> str:
    """One finding of a file result (path, archive_path, content, score) for a terminal."""
    notes = [f"Confidence: {SHOWN[item['confidence']]}", f"Machine learning based score for file: {row.get('score') or 0.0:.2f}"]
    if HELP.get(item["rule"]):
        notes.append(f"Help: {HELP[item['rule']]}")
    return diagnostic(row["file_path"], row["archive_path"], row["content"], [(item["start"], item["end"], item["rule"])], item["description"], item["rule"], notes, colored)


def file_diagnostic(row: dict, items: list[dict]) -> str:
    """All findings of a file in one diagnostic."""
    return diagnostic(row["file_path"], row["archive_path"], row["content"], [(i["start"], i["end"], f"{i['rule']}: {i['description']}") for i in items])


def annotated(results: DataFrame, context: int = 2) -> DataFrame:
    """File results (file_path, archive_path, content, findings, ...) with a column ``annotations``: a preview for each finding."""
    at = {name: results.columns.index(name) for name in ("file_path", "archive_path", "content", "findings")}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at.values()))
            made = [[preview(path, archive, f["rule"], f["confidence"], text or "", f["start"], f["end"], context) for f in found or []] for path, archive, text, found in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], names=[*batch.schema.names, "annotations"])

    return results.mapInArrow(run, f"{schema}, annotations array<string>")


def item_rows(results: DataFrame, annotate: bool = False) -> DataFrame:
    """One row for each finding: path, archive_path, label, rule, description, confidence, location_start, location_end, annotation."""
    made = annotated(results) if annotate else results.withColumn("annotations", F.lit(None).cast("array<string>"))
    flat = made.select("file_path", "archive_path", "annotations", F.posexplode("findings").alias("i", "x"))
    return flat.select(
        F.col("file_path").alias("path"), "archive_path", "x.label", "x.rule", "x.description", level_name(F.col("x.confidence")).alias("confidence"),
        F.col("x.start").cast("long").alias("location_start"), F.col("x.end").cast("long").alias("location_end"), F.get("annotations", F.col("i")).alias("annotation"),
    )


def json_lines(results: DataFrame, annotate: bool = False) -> DataFrame:
    """One JSON text for each finding, column ``value``; absent archive paths and annotations are left out."""
    rows = item_rows(results, annotate)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def result_dicts(results: DataFrame) -> Iterator[dict]:
    """File results as dictionaries, one at a time: path, archive_path, score and items with their annotations."""
    names = {level: name for name, level in C.LEVELS.items()}
    for row in annotated(results).toLocalIterator():
        items = [
            {"label": f["label"], "rule": f["rule"], "description": f["description"], "confidence": names[f["confidence"]], "location": {"start": f["start"], "end": f["end"]}, "annotation": note}
            for f, note in zip(row["findings"] or [], row["annotations"] or [])
        ]
        yield {"path": row["file_path"], "archive_path": row["archive_path"], "score": row["score"] if "score" in row else None, "items": items}


def annotated_files(results: DataFrame) -> DataFrame:
    """name (``audit_<sha256 of the path>.py``) and text of an annotated file for each result with a finding."""
    at = [results.columns.index(name) for name in ("file_path", "archive_path", "content", "findings")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            names, texts = [], []
            for path, archive, text, found in zip(*(batch.column(i).to_pylist() for i in at)):
                if found:
                    names.append(f"audit_{hashlib.sha256(display_path(path, archive).encode()).hexdigest()}.py")
                    texts.append(file_diagnostic({"file_path": path, "archive_path": archive, "content": text or ""}, found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])

    return results.mapInArrow(run, "name string, text string")


def write_annotated(results: DataFrame, folder: str) -> None:
    """Writes ``annotated_files`` below ``folder``, one file each, by the tasks that have them."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            for name, text in zip(part["name"], part["text"]):
                write_bytes(f"{folder.rstrip('/')}/{name}", text.encode())
            yield part[["name"]]

    annotated_files(results).mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def rules_markdown() -> str:
    """The rules, in their order, as a table in Markdown."""
    return "\n".join(["| Code | Name | Description |", "| --- | --- | --- |", *(f"| {code} | {name} | {text} |" for code, name, text, _ in C.RULES)]) + "\n"


def benchmark(results: DataFrame, sources: DataFrame, least: int = 1) -> dict:
    """Counts of a run: files, matches, by confidence and rule (most first), and archives without a match (by path).

    Each count is one aggregate; only the 40 rules, the 5 levels and the paths
    of archives without a match come to the driver.
    """
    hits = results.select("archive_path", F.explode("findings").alias("x")).where(F.col("x.confidence") >= least)
    hits = cut(hits.select("archive_path", F.col("x.confidence").alias("c"), F.col("x.rule").alias("r")))  # so that the audit is done once
    by_level = hits.groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    by_rule = hits.groupBy("r").count().orderBy(F.desc("count"), "r").collect()
    missing = sources.select("archive_path").where("archive_path IS NOT NULL").distinct().join(hits.select("archive_path").distinct(), "archive_path", "left_anti")
    return {
        "total_files": sources.count(),
        "total_matches": sum(r["count"] for r in by_level),
        "confidence": [(r["c"], r["count"]) for r in by_level],
        "rules": [(r["r"], r["count"]) for r in by_rule],
        "missing": missing.orderBy("archive_path"),
    }


def benchmark_text(path: str, counts: dict, seconds: float, print_missing: bool = False) -> Iterator[str]:
    """The lines of a benchmark's report."""
    names = {code: name for code, name, *_ in C.RULES}
    yield f"Benchmark results for: {path}"
    yield f"Total files: {counts['total_files']}"
    yield f"Total matches: {counts['total_matches']}"
    yield f"Time elapsed: {seconds:.3f}s"
    yield "\nMatches by Confidence:"
    for level, n in counts["confidence"]:
        yield f"  {SHOWN[level]}: {n}"
    yield "\nMatches by Rule Code:"
    for code, n in counts["rules"]:
        yield f"{names[code]} ({code}): {n}"
    if print_missing:
        rows = [r[0] for r in counts["missing"].toLocalIterator()]
        if rows:
            yield "\nZip paths with missing audits:"
        for row in rows:
            yield f"Missing audits for: {row}"
