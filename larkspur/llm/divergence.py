"""Audit of how sources differ in their words, language by language.

Workers count the terms of their documents by language and source, and send
the counts to shards by a hash of language and term.  In a shard DuckDB adds
the counts up, keeps the terms that stand in enough documents and, once Spark
has the totals of all groups, works out smoothed shares and partial sums of
differences between pairs of sources.  Spark adds the partial sums and ranks.

The sums over pairs never spread a term over all sources: with z the share of
a term that a source has not, two sources differ by V |z - z'|, by what each
term of only one of them adds (summed by distinct share, against the other's
z), and by a correction for each term that both have.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import cut, map_arrow, partitions_for, table
from larkspur.llm._text import as_bytes, chunks
from larkspur.llm.impact_index import term_runs

MIN_DOCS, TOP_TERMS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Counts a worker adds up before it sends them, bytes of text and rows of kept counts to a shard, memory of DuckDB in a worker.
HELD, SHARD_BYTES, SHARD_ROWS, MEMORY = 200_000, 4_000_000, 200_000, "400MB"

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial counts of docs (lang, source, text): occurrences n and documents of each term in each group."""

    def rows(held: dict) -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (count, seen) in held.items():
            langs += [lang] * len(count)
            sources += [source] * len(count)
            terms += count.keys()
            n += count.values()
            docs += map(seen.__getitem__, count)
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([text(langs), text(sources), text(terms), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in chunks(batches):
            for lang, source, text in zip(*map(as_bytes, batch.columns)):
                count, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(count)
                here: set[bytes] = set()
                for words in term_runs(text, _LETTERS):
                    count.update(words)
                    here.update(words)
                seen.update(here)
                size += len(count)
                if size >= HELD:
                    yield rows(held)
                    held, size = {}, 0
        if size:
            yield rows(held)

    return map_arrow(docs, run, COUNTS)


_KEPT = """
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n
FROM counts SEMI JOIN (SELECT lang, term FROM counts GROUP BY lang, term HAVING sum(docs) >= {min_docs}) USING (lang, term)
GROUP BY lang, source, term
"""

_PARTIAL = f"""
WITH p AS MATERIALIZED (
  SELECT lang, source, term, 1 + (CAST({SCALE} AS HUGEINT) * (n + {SMOOTH})) // (total + {SMOOTH} * v) AS p, zero, n FROM counts JOIN sources USING (lang, source)),
shares AS (SELECT lang, source, p, zero, count(*) AS k FROM p GROUP BY ALL),
alone AS (
  SELECT a.lang, least(a.source, b.source) AS x, greatest(a.source, b.source) AS y, sum(k * (abs(a.p - b.zero) - abs(a.zero - b.zero))) AS f
  FROM shares a JOIN sources b ON b.lang = a.lang AND b.source <> a.source GROUP BY ALL),
both_ AS (
  SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p) + abs(a.zero - b.zero) - abs(a.p - b.zero) - abs(b.p - a.zero)) AS f
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND a.source < b.source GROUP BY ALL),
language AS (SELECT lang, any_value(lang_total) AS lang_total, any_value(v) AS v FROM sources GROUP BY lang),
q AS (SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * (sum(n) + {SMOOTH})) // (any_value(lang_total) + {SMOOTH} * any_value(v)) AS q FROM counts JOIN language USING (lang) GROUP BY lang, term),
over_ AS (
  SELECT lang, source, term, p - q AS f, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r
  FROM p JOIN q USING (lang, term) WHERE p > q)
SELECT 'pair' AS part, lang, x AS source, y AS item, CAST(sum(f) AS BIGINT) AS value FROM (FROM alone UNION ALL FROM both_) GROUP BY lang, x, y
UNION ALL
SELECT 'term', lang, source, term, CAST(f AS BIGINT) FROM over_ WHERE r <= {{top_terms}}
"""


def _duck(sql: str, schema: pa.Schema, **tables: pa.Table) -> pa.Table:
    """The rows of a query over Arrow tables, on one thread with bounded memory; it spills to the worker's own folder."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": tempfile.gettempdir()})
    try:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(sql).to_arrow_table().cast(schema)
    finally:
        con.close()


_KEPT_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
_PARTIAL_SCHEMA = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text, ...); null counts as the empty text in all three.

    Part ``pair``: how far the shares of all kept terms of the language lie
    from those of each other source.  Part ``term``: the ``top_terms`` terms
    whose share in the source is most above that in the language.  Equal
    values go by the item's bytes.  Repeated rows count as often as they
    stand; a source without terms is a source; a language of one source has no
    pairs and an empty table no rows.  A very long text is split a megabyte at
    a time.
    """
    spark = docs.sparkSession
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    docs = docs.select(part("lang"), part("source"), part("text"))
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = partitions_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], SHARD_BYTES, at_least)
    shard = lambda n: F.pmod(F.xxhash64("lang", "term"), F.lit(n))

    kept_sql, partial_sql = _KEPT.format(min_docs=min_docs), _PARTIAL.format(top_terms=top_terms)
    counts = count_terms(docs).withColumn("shard", shard(shards)).repartition(shards, "shard")
    kept = cut(counts.groupBy("shard").applyInArrow(lambda t: _duck(kept_sql, _KEPT_SCHEMA, counts=t.drop_columns(["shard"])), "lang string, source string, term string, n long"))

    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sources = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(terms, "lang", "left")
    none = F.lit(0).cast("long")
    sources = sources.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "v", "lang_total")])
    sources = cut(sources.withColumn("zero", F.expr(f"CASE WHEN v > 0 THEN 1 + {SCALE * SMOOTH} div (total + {SMOOTH} * v) ELSE 0L END")))

    shards = partitions_for(kept.count(), SHARD_ROWS)  # each gives a row for every pair and 50 for every source, so no more than the counts need
    for_all = sources.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    partial = (
        kept.withColumn("shard", shard(shards))
        .groupBy("shard")
        .cogroup(for_all.groupBy("shard"))
        .applyInArrow(lambda c, s: _duck(partial_sql, _PARTIAL_SCHEMA, counts=c, sources=s) if c.num_rows else _PARTIAL_SCHEMA.empty_table(), "part string, lang string, source string, item string, value long")
    )
    partial = cut(partial)

    summed = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("f"))
    summed = summed.select("lang", "source", "item", "f").unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "f"))
    other = sources.select("lang", F.col("source").alias("item"), F.col("zero").alias("q"))
    pairs = sources.join(other, "lang").where("source <> item").join(summed, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("zero") - F.col("q")) + F.coalesce("f", none)).alias("value"))
    found = pairs.unionByName(partial.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
place AS MATERIALIZED (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM doc) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, t, sum(n) AS n FROM place GROUP BY lang, t HAVING count(*) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM doc),
full_ AS MATERIALIZED (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, k.n AS m
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, t, sum(n) AS n FROM place GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, sum(m) OVER (PARTITION BY lang, source) AS ln, count(*) OVER (PARTITION BY lang, source) AS v FROM full_),
share AS MATERIALIZED (
  SELECT lang, source, t, n, 1 + ({SCALE} * (n + {SMOOTH})) // (gn + {SMOOTH} * v) AS p, 1 + ({SCALE} * (m + {SMOOTH})) // (ln + {SMOOTH} * v) AS q FROM sized),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM share a JOIN share b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k FROM found)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= {TOP_TERMS}
"""
