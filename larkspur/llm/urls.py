"""URL filter: rules first, then segmented host and path words in naive Bayes.

Host labels such as ``cheappills`` are split into words by a unigram model: the
most probable split is found by Viterbi's recursion, with word counts from the
pages' own text and a penalty by length for pieces that are no word.  A
multinomial naive Bayes model over the words of host and path, trained on the
pages that rules decide and on a few fixed words, judges the others.

Nothing grows on one machine: word counts, host words and token weights stay
tables.  Hosts and path shapes are scored once each and joined back to pages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import cut, table

#: Longest word of a host label: no longer label is valid in the domain name system.
MAX_WORD = 63
# The registered query's rules, and words that speak for a verdict whatever the pages hold.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SEEDS = {
    "block": "spam farm cheap pills casino poker bet slots loan loans viagra adult xxx porn escort free win winner bonus click ads deal deals replica warez torrent crack".split(),
    "allow": "news wiki docs blog science school library museum university research journal forum weather health recipes history".split(),
}
SEED_WEIGHT = 50


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://`` or for null."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """word and n over the text between the tags of all ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        tags, letters = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I), re.compile(r"[^\W\d_]+")
        for batch in batches:
            n: Counter[str] = Counter()
            for html in batch.column(0).to_pylist():
                n.update(letters.findall(tags.sub(" ", html or "").lower()))
            kept = [w for w in n if len(w) <= MAX_WORD]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([n[w] for w in kept], pa.int64())], names=["word", "n"])

    seeds = pages.sparkSession.createDataFrame([(w, SEED_WEIGHT) for ws in SEEDS.values() for w in ws], "word string, n long")
    counted = pages.select("html").mapInArrow(run, "word string, n long")
    return counted.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split; of equal ones the one with the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            p = math.log(n / total) if n else -math.log(total) - 2.3 * (end - start)
            options.append((best[start][0] + p, -start, start))
        score, _, start = max(options)
        best.append((score, start))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label and words of the distinct ``label`` column, by the counts of ``words``."""
    total = words.agg(F.sum("n")).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_pylist()
            split = [split_label(x, dict(c or ()), total) for x, c in zip(label, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], names=["label", "words"])

    parts = labels.select("label", F.expr(f"explode(flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({MAX_WORD}, length(label) - i + 1)), k -> substring(label, i, k)))))").alias("word")).distinct()
    known = parts.join(words, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    return labels.join(known, "label", "left").select("label", "counts").mapInArrow(run, "label string, words array<string>")


def _path_tokens(shape: Column) -> Column:
    return F.filter(F.split(shape, r"[/._\-]+"), lambda x: x != "")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Judges every row of ``pages`` (page_id, url, html, ...).

    Returns page_id, host, path, rule, verdict and score (log odds of allow;
    null where a rule decides).  Null urls and those without ``://`` have an
    empty host and path and are judged by the training pages' shares alone,
    ties allowed.  Null html adds no words.  Rows with null or repeated ids are
    judged like all others.  Without any training page only the fixed words
    count.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict", F.regexp_replace(lower_ascii(F.col("path")), "[0-9]+", "#").alias("shape"))
    counted = cut(rows.groupBy("host", "shape", "verdict").agg(F.count("*").alias("n")))  # one row for each kind of url
    hosts = counted.select("host").where("host <> ''").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("i", "label")).where("label <> ''")
    split = cut(segment(labels.select("label").distinct(), cut(word_counts(pages))))
    host_tokens = labels.join(split, "label").select("host", F.explode("words").alias("token"))
    host_tokens = cut(host_tokens.groupBy("host", "token").agg(F.count("*").alias("k")))
    shapes = counted.select("shape").distinct()
    shape_tokens = shapes.select("shape", F.explode(_path_tokens(F.col("shape"))).alias("token")).groupBy("shape", "token").agg(F.count("*").alias("k"))

    seen = counted.where("verdict IS NOT NULL")
    by_host = seen.groupBy("host", "verdict").agg(F.sum("n").alias("n")).join(host_tokens, "host")
    by_shape = seen.groupBy("shape", "verdict").agg(F.sum("n").alias("n")).join(shape_tokens, "shape")
    seeds = pages.sparkSession.createDataFrame([(w, v, SEED_WEIGHT) for v, ws in SEEDS.items() for w in ws], "token string, verdict string, n long")
    evidence = by_host.select("token", "verdict", (F.col("n") * F.col("k")).alias("n")).unionByName(by_shape.select("token", "verdict", (F.col("n") * F.col("k")).alias("n"))).unionByName(seeds)
    allow, block = (F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)) for v in ("allow", "block"))
    tokens = cut(evidence.groupBy("token").agg(allow.alias("a"), block.alias("b")))
    n_a, n_b, size = tokens.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    p_a, p_b = seen.agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0))).first()
    prior = math.log(((p_a or 0) + 1) / ((p_b or 0) + 1))
    odds = tokens.select("token", (F.log((F.col("a") + 1) / (n_a + size)) - F.log((F.col("b") + 1) / (n_b + size))).alias("w"))
    scored = lambda t, key: t.join(odds, "token").groupBy(key).agg(F.sum(F.col("k") * F.col("w")).alias("w_" + key))
    # one row for each kind of url again, joined to the pages by both parts
    kinds = counted.select("host", "shape").distinct().join(scored(host_tokens, "host"), "host", "left").join(scored(shape_tokens, "shape"), "shape", "left")
    kinds = kinds.select("host", "shape", F.round(F.lit(prior) + F.coalesce("w_host", F.lit(0.0)) + F.coalesce("w_shape", F.lit(0.0)), 9).alias("odds"))
    out = rows.join(kinds, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("odds") >= 0, "allow").otherwise("block")).alias("verdict"), F.when(F.col("verdict").isNull(), F.col("odds")).alias("score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return judge(table(spark, sf_dir, "pages"))
