"""Audits of paths and texts, as data frames and as dictionaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.operators import features, model, rules
from larkspur.sinks import report
from larkspur.sources import scan


def level(name: str) -> int:
    """A level by its name or one of its other spellings, in any case."""
    plain = name.strip().lower()
    if plain not in C.LEVELS and plain not in C.LEVEL_ALIASES:
        raise ValueError(f"unknown confidence: {name}")
    return C.LEVELS.get(plain) or C.LEVEL_ALIASES[plain]


def unknown_codes(codes: list[str]) -> list[str]:
    """The codes that no rule has; they are still used, and find nothing."""
    return [c for c in codes if c not in {code for code, *_ in C.RULES}]


def file_results(sources: DataFrame, scorer: model.TreeModel | None = None, least_score: float = 0.0, extra: Sequence[rules.Rule] = ()) -> DataFrame:
    """``sources`` with findings and score; the features are computed only for a scorer.

    Rules of one's own find things where no score is asked for: a model knows nothing of them.
    """
    if scorer is not None and extra:
        raise ValueError("a model has no features of rules that it was not trained with")
    if scorer is None:
        found = rules.with_findings(rules.with_facts(sources), extra).drop("facts").withColumn("score", F.lit(0.0))
        return found if least_score <= 0 else found.where(F.lit(False))
    return model.scored(features.features(sources), scorer, least_score)


def kept(results: DataFrame, least: int = 1, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Results with the findings of at least a confidence, of included codes (all where none is named) and no excluded one."""

    def keep(x):
        out = x["confidence"] >= least
        if include:
            out &= x["rule"].isin(list(include))
        return out & ~x["rule"].isin(list(exclude)) if exclude else out

    return results.withColumn("findings", F.filter("findings", keep))


def audit_path(spark: SparkSession, path: str, exclude: list[str] = (), scorer: model.TreeModel | None = None) -> DataFrame:
    """File results of everything below ``path``; raises where there is no source."""
    return file_results(scan.scan(spark, path, exclude), scorer)


def audit_file(spark: SparkSession, path: str, scorer: model.TreeModel | None = None) -> DataFrame:
    """File results of one file, of an archive's members for an archive; raises where it cannot be read."""
    sources = scan.scan(spark, path)
    bad = sources.where("error IS NOT NULL AND archive_path IS NULL").select("error").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0][0]}")
    return file_results(sources, scorer)


def audit_source(spark: SparkSession, text: str, path: str = "a.py") -> DataFrame:
    """File results of one text."""
    return file_results(spark.createDataFrame([("0", None, path, text, None)], scan.SCHEMA))


def to_dicts(results: DataFrame) -> Iterator[dict]:
    """Results as dictionaries with annotated items, one file at a time."""
    return report.result_dicts(results)
