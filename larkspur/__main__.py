"""The command line: audit, rules, benchmark, dataset, dump-package."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession

from larkspur import api
from larkspur.operators import model
from larkspur.sinks import report
from larkspur.sources import datasets, scan


def _codes(text: str) -> list[str]:
    return [c for c in (x.strip() for x in text.split(",")) if c]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit", help="audit a file, an archive or a folder")
    audit.add_argument("path")
    audit.add_argument("--output-format", choices=["terminal", "json"], default="terminal")
    audit.add_argument("--output", help="a folder for JSON lines, or a file for terminal text")
    audit.add_argument("--include", type=_codes, default=[])
    audit.add_argument("--exclude", type=_codes, default=[])
    audit.add_argument("--min-confidence", type=api.level, default=api.level("low"))
    audit.add_argument("--min-score", type=float, default=0.0)
    audit.add_argument("--exclude-names", help="a text file of file names to leave out")
    audit.add_argument("--model", help="a model in JSON, gzipped or not")
    audit.add_argument("--annotate", action="store_true", help="previews in JSON lines")
    audit.add_argument("--dump", help="a folder for annotated files")
    commands.add_parser("rules", help="the rules as a table")
    bench = commands.add_parser("benchmark", help="counts of findings")
    bench.add_argument("path")
    bench.add_argument("--min-confidence", type=api.level, default=api.level("very_low"))
    bench.add_argument("--missing", action="store_true", help="list archives without a finding")
    data = commands.add_parser("dataset", help="labelled datasets in JSON lines").add_subparsers(dest="task", required=True)
    made = data.add_parser("generate-features")
    made.add_argument("input")
    made.add_argument("output")
    made.add_argument("--limit", type=int)
    valid = data.add_parser("validate")
    valid.add_argument("input")
    valid.add_argument("--output")
    valid.add_argument("--min-confidence", type=api.level, default=api.level("very_low"))
    valid.add_argument("--no-rules", action="store_true")
    valid.add_argument("--code", action="store_true")
    one = data.add_parser("read-file")
    one.add_argument("input")
    one.add_argument("file")
    dump = commands.add_parser("dump-package", help="texts of an archive's members")
    dump.add_argument("path")
    dump.add_argument("--filter")
    return top


def _values(rows) -> Iterator[str]:
    return (r["value"] for r in rows.select("value").toLocalIterator())


def run(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """The lines that a command prints."""
    if args.command == "rules":
        yield report.rules_markdown().rstrip("\n")
    elif args.command == "audit":
        for code in api.unknown_codes([*args.include, *args.exclude]):
            logging.error("unknown rule code: %s", code)
        names = scan.exclusions("\n".join(r[0] for r in spark.read.text(args.exclude_names).toLocalIterator())) if args.exclude_names else []
        scorer = model.load(spark, args.model) if args.model else None
        results = api.kept(api.file_results(scan.scan(spark, args.path, names), scorer, args.min_score), args.min_confidence, args.include, args.exclude)
        results = scan.in_walk_order(results).orderBy("seq")  # written once, and shown in the order of the walk
        if args.dump:
            report.write_annotated(results, args.dump)
        if args.output_format == "json":
            lines = report.json_lines(results, args.annotate)
            if args.output:
                lines.write.mode("overwrite").text(args.output)
            else:
                yield from _values(lines)
        else:
            shown = (report.finding_diagnostic(row.asDict(), f.asDict(), colored=not args.output and sys.stdout.isatty()) for row in results.toLocalIterator() for f in row["findings"] or [])
            if args.output:
                with open(args.output, "w", encoding="utf-8") as out:
                    out.writelines(x + "\n" for x in shown)
            else:
                yield from shown
    elif args.command == "benchmark":
        began = time.time()
        sources = scan.scan(spark, args.path)
        counts = report.benchmark(api.file_results(sources), sources, args.min_confidence)
        yield from report.benchmark_text(args.path, counts, time.time() - began, args.missing)
    elif args.command == "dump-package":
        yield from _values(datasets.package_dump(scan.scan(spark, args.path), args.filter))
    elif args.task == "generate-features":
        datasets.feature_lines(datasets.read(spark, args.input), args.limit).write.mode("overwrite").text(args.output)
    elif args.task == "validate":
        lines = datasets.validation(datasets.read(spark, args.input), args.min_confidence, args.no_rules, args.code)
        if args.output:
            lines.write.mode("overwrite").text(args.output)
        else:
            yield from _values(lines)
    else:
        found = datasets.code_of(datasets.read(spark, args.input), args.file).collect()
        if not found:
            raise SystemExit(f"no such file in the dataset: {args.file}")
        yield found[0]["content"]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    for line in run(spark, args):
        print(line)


if __name__ == "__main__":
    main()
