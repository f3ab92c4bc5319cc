"""Benchmark decontamination by winnowing.

Every k-gram of words is hashed and the minimum of each window of ``w``
consecutive k-grams (the rightmost on ties) is kept as a fingerprint.  With
k + w - 1 = 10, any span of ten words that a document shares with an item has
a fingerprint that both keep.  Fingerprints are joined by hash; a hit carries
the words around it, and the join's rows extend it word by word to the whole
shared span.  Items of fewer words than ten are one gram of their own length.

Before the join, documents drop fingerprints whose hash falls in no slot of a
bit map of the items' hashes.  The map has a fixed size (2^22 bits), whatever
the benchmark's, and never drops a true hit; the join itself is left to Spark,
which splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import cut, map_arrow, row_key, table
from larkspur.llm._text import ALNUM, Words, as_bytes, chunks, grams, window_argmin

WINDOW, GRAM, SLOT_BITS = 10, 5, 22

_PRINT = pa.struct([("k", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("ctx", pa.string())])
_PRINT_SQL = "array<struct<k:int,h:long,pos:int,lead:int,ctx:string>>"


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _fingerprints(words: Words, window: int, gram: int, lengths: list[int], keep, short_items: bool) -> tuple[np.ndarray, list[dict]]:
    """Text index and fingerprint of every hit.

    lengths: the gram lengths of items shorter than a window, to look for in
    full.  keep: a test of hashes.  short_items: the texts are items, and those
    shorter than a window are one gram.
    """
    h, n = words.hashes(), len(words)
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    if n >= window:
        g = grams(h, gram)
        at = window_argmin(g, window - gram + 1, rightmost=True)
        inside = words.doc[: n - window + 1] == words.doc[window - 1 :]
        at = np.unique(at[inside])
        at = at[keep(g[at])]
        found.append((at, gram, g[at]))
    for k in lengths:
        if n >= k:
            g = grams(h, k)
            ok = words.doc[: n - k + 1] == words.doc[k - 1 :]
            if short_items:
                ok &= words.counts[words.doc[: n - k + 1]] == k
            at = np.flatnonzero(ok)
            at = at[keep(g[at])]
            found.append((at, k, g[at]))
    docs, out, reach = [], [], window - gram
    for at, k, hashes in found:
        for i, value in zip(at.tolist(), hashes.view(np.int64).tolist()):
            d = words.doc[i]
            lo, hi = (i, i + k) if k != gram or short_items and words.counts[d] < window else (max(words.first[d], i - reach), min(words.first[d + 1], i + k + reach))
            docs.append(int(d))
            out.append({"k": k, "h": value, "pos": i - int(words.first[d]), "lead": i - int(lo), "ctx": words.text(lo, hi).decode()})
    return np.array(docs, np.int64), out


def _lists(docs: np.ndarray, prints: list[dict], n: int) -> pa.Array:
    order = np.argsort(docs, kind="stable")
    offsets = np.searchsorted(docs[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([prints[i] for i in order], _PRINT))


def _prints(df: DataFrame, columns: str, window: int, gram: int, lengths: list[int], slots: np.ndarray | None, short_items: bool) -> DataFrame:
    """The columns named but text, n_words and the fingerprints kept."""
    held = columns.split(", ")
    schema = df.select(*held).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = (lambda x: slots[_slots(x)]) if slots is not None else (lambda x: np.ones(len(x), bool))
        for batch in chunks(batches):
            words = Words(as_bytes(batch.column(len(held))), ALNUM, lower=True)
            docs, prints = _fingerprints(words, window, gram, lengths, keep, short_items)
            arrays = [batch.column(i) for i in range(len(held))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(words.counts, pa.int64()), _lists(docs, prints, batch.num_rows)], names=[*held, "n_words", "prints"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return map_arrow(df.select(*held, "text"), run, f"{types}, n_words long, prints {_PRINT_SQL}")


def _extend(window: int, gram: int):
    """Rows of a document's print beside an equal-hashed item's print -> the shared span's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            at, start, end = [], [], []
            for i, (k, pos, lead, ctx, item_lead, item_ctx) in enumerate(zip(r["k"], r["pos"], r["lead"], r["ctx"], r["item_lead"], r["item_ctx"])):
                mine, its = ctx.split(" "), item_ctx.split(" ")
                if len(its) < window:  # a short item: its whole text
                    if mine[lead : lead + k] == its:
                        at.append(i), start.append(pos), end.append(pos + k)
                    continue
                a = 0
                while a < min(lead, item_lead) and mine[lead - a - 1] == its[item_lead - a - 1]:
                    a += 1
                b = 0
                while lead + b < len(mine) and item_lead + b < len(its) and mine[lead + b] == its[item_lead + b]:
                    b += 1
                if a + b >= window:
                    at.append(i), start.append(pos - a), end.append(pos + b)
            got = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [got.column("_k1"), got.column("_k2"), pa.array(start, pa.int32()), pa.array(end, pa.int32()), got.column("items")],
                names=["_k1", "_k2", "start", "end", "items"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Finds the words of ``docs`` (doc_id, text, ...) inside occurrences of windows of ``benchmark`` (item_id, text, ...).

    Returns per document row: doc_id, _k1, _k2 (its content key), n_words,
    spans (array of start and end words, may overlap), items (sorted distinct
    item ids).  Null, empty and wordless texts have no words and no hits; items
    without words never match; repeated items and rows count each; null ids
    are kept as they are, and null item ids are left out of items.
    """
    lengths = list(range(1, window))
    items = _prints(benchmark, "item_id", window, gram, lengths, None, True).select("item_id", "n_words", F.explode("prints").alias("p"))
    items = cut(items.select("item_id", "n_words", "p.*"))
    slots = np.zeros(1 << SLOT_BITS, bool)
    taken = items.select(F.shiftrightunsigned("h", 64 - SLOT_BITS).alias("s")).distinct().toArrow()  # at most 2^22 numbers
    slots[taken.column(0).to_numpy()] = True
    lengths = sorted(r[0] for r in items.where(F.col("n_words") < window).select("k").distinct().collect())  # at most 9

    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    mine = cut(_prints(keyed, "doc_id, _k1, _k2", window, gram, lengths, slots, False))
    hits = mine.where(F.size("prints") > 0).select("_k1", "_k2", F.explode("prints").alias("p")).select("_k1", "_k2", "p.*")
    its = items.groupBy("k", "h", F.col("lead").alias("item_lead"), F.col("ctx").alias("item_ctx")).agg(F.collect_set("item_id").alias("items"))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    spans = hits.join(its, ["k", "h"]).select("_k1", "_k2", "k", "pos", "lead", "ctx", "item_lead", "item_ctx", "items")
    spans = map_arrow(spans, _extend(window, gram), f"_k1 long, _k2 long, start int, end int, items array<{item_type}>")
    by_doc = spans.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return mine.drop("prints").join(by_doc, ["_k1", "_k2"], "left").withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), "items": F.coalesce("items", F.array().cast(f"array<{item_type}>"))})


def count_words(spans) -> F.Column:
    """Distinct words that an array of spans covers."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )
    return merged["n"].cast("long")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside benchmark windows, and the items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", count_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
