"""Ranked lexical search over a bit-sliced index of integer impacts.

Every document has its terms counted once.  The documents of a task stand in
blocks of ``BLOCK``; in a block a term's impacts are kept as slices, one bitmap
over the block's documents for each binary digit of the impact.  The scores of
a query are the slices of its terms added with carries, 64 documents a machine
word and all queries of a group at once.  The best k of a block are found on
the slices of the sum, from the most significant one down: documents with the
digit set are ahead of those without.  Spark merges the best of the blocks.

An impact is a term's weight, floor(1000 ln((2N + 2) / (2 df + 1))), times
1000000000 tf div (1000 tf + 8 m) with m = 25 + 75 n N div L: N documents with
terms, L terms in all, df documents with the term, tf times in a document of n.
Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import cut, map_arrow, partitions_for, table
from larkspur.llm._text import as_bytes, chunks

K, BLOCK = 10, 4096
#: Queries whose slices are held at once, and terms of queries that are searched in one pass over the documents.
GROUP, PASS_TERMS = 64, 1_000_000
#: Bytes of text that are split into terms at once.
STEP = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTED = "doc_id long, n long, terms array<int>, counts array<long>"


def term_runs(text: bytes | None, pattern: re.Pattern = _TERM) -> Iterator[list[bytes]]:
    """The terms of a text, about ``STEP`` bytes at a time."""
    text, at = (text or b"").translate(_LOWER), 0
    while at < len(text):
        end = min(at + STEP, len(text))
        if inside := pattern.match(text, end):  # a term that crosses the end stays whole
            end = inside.end()
        yield pattern.findall(text, at, end)
        at = end


def count_terms(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, number of all terms, and the terms in ``number`` with their counts, of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in chunks(batches):
            n, terms, counts = [], [], []
            for text in as_bytes(batch.column(1)):
                total, found = 0, Counter()
                for words in term_runs(text):
                    total += len(words)
                    found.update(filter(number.__contains__, words))
                n.append(total)
                terms.append([number[t] for t in found])
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, COUNTED)


class Slices:
    """The impacts of one block of documents: for each term, digit and word of 64 documents, the bits."""

    def __init__(self, terms: np.ndarray, slots: np.ndarray, impacts: np.ndarray, n_docs: int):
        order = np.lexsort((slots, terms))
        self.terms, self.slots, self.impacts = terms[order], slots[order], impacts[order].astype(np.uint64)
        self.words = -(-n_docs // 64)
        self.digits = int(self.impacts.max()).bit_length() if len(self.impacts) else 0

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Slices of the sorted terms ``wanted`` and, last, of none: an array by digit, term and word."""
        out = np.zeros((self.digits, len(wanted) + 1, self.words), np.uint64)
        low, high = np.searchsorted(self.terms, wanted), np.searchsorted(self.terms, wanted, side="right")
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        if not len(at):
            return out
        row, word, bit = np.repeat(np.arange(len(wanted)), size), self.slots[at] >> 6, (self.slots[at] & 63).astype(np.uint64)
        place = row * self.words + word
        first = np.flatnonzero(np.diff(place, prepend=-1))
        for digit in range(self.digits):
            bits = (self.impacts[at] >> np.uint64(digit) & np.uint64(1)) << bit
            out[digit, row[first], word[first]] = np.bitwise_or.reduceat(bits, first)
        return out


def add(total: list[np.ndarray], more: np.ndarray) -> None:
    """Adds slices to the slices of a sum, digit by digit with carries, in place."""
    carry = None
    for digit in range(max(len(more), len(total))):
        if digit >= len(more) and carry is None:
            return
        if digit == len(total):
            total.append(np.zeros_like(more[0]))
        a, b = total[digit], more[digit] if digit < len(more) else None
        if b is None:
            total[digit], carry = a ^ carry, a & carry
        elif carry is None:
            total[digit], carry = a ^ b, a & b
        else:
            half = a ^ b
            total[digit], carry = half ^ carry, (a & b) | (half & carry)
    if carry is not None and carry.any():
        total.append(carry)


def best(total: list[np.ndarray], k: int) -> list[tuple[int, int]]:
    """(slot, score) of the k highest scores above 0, those of lower slots first among equals."""
    if not total:
        return []
    ahead, equal = np.zeros_like(total[0]), np.bitwise_or.reduce(total)
    for digit in reversed(total):
        here = ahead | (equal & digit)
        n = int(np.bitwise_count(here).sum())
        if n > k:
            equal = equal & digit
        else:
            ahead, equal = here, equal & ~digit
            if n == k:
                break
    slots = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    sure = slots(ahead)
    picked = np.concatenate((sure, slots(equal)[: k - len(sure)])) if len(sure) < k else sure
    score = [sum(int(d[s >> 6] >> np.uint64(s & 63) & np.uint64(1)) << i for i, d in enumerate(total)) for s in picked.tolist()]
    return sorted(zip(picked.tolist(), score), key=lambda x: (-x[1], x[0]))


def _search(counted: DataFrame, queries: list[list[int]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its number), doc_id and score of the best k documents of each block."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, n = t.column("doc_id").to_pylist(), t.column("n").to_numpy()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # slots by ascending id
        slot_of = np.empty(len(ids), np.int64)
        slot_of[order] = np.arange(len(ids))
        lists = t.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        terms, tf = lists.flatten().to_numpy().astype(np.int64), t.column("counts").combine_chunks().flatten().to_numpy()
        m = np.repeat([25 + 75 * x * n_docs // max(n_terms, 1) for x in n.tolist()], sizes).astype(np.int64)
        slices = Slices(terms, np.repeat(slot_of, sizes), weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), len(ids))
        out: list[tuple] = []
        for at in range(0, len(queries), GROUP):
            group = queries[at : at + GROUP]
            wanted = np.unique(np.array([x for q in group for x in q], np.int64))
            bits, total = slices.of(wanted), []
            longest = max(map(len, group), default=0)
            # a query shorter than the longest of its group adds the slices of no term, which are empty
            places = np.array([np.append(np.searchsorted(wanted, q), np.full(longest - len(q), len(wanted))) for q in group], np.int64).reshape(len(group), longest)
            for j in range(longest):
                add(total, bits[:, places[:, j], :])
            for i in range(len(group)):
                out += [(at + i, ids[order[s]], score) for s, score in best([d[i] for d in total], k)]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query", "doc_id", "score"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                held.append(part)
                rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
                if rows == BLOCK:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    return map_arrow(counted, run, "query long, doc_id long, score long")


def _search_pass(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The search for a bounded set of queries, of which only terms and numbers are on the driver."""
    spark = docs.sparkSession
    asked = queries.collect()
    number: dict[bytes, int] = {}
    as_terms = [[number.setdefault(t, len(number)) for words in term_runs((q.text or "").encode()) for t in words] for q in asked]
    counted = cut(count_terms(docs, number))
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.full(max(len(number), 1), 0, np.int64)
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term asked for
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    found = _search(counted, as_terms, weight, n_docs, n_terms, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, q.item_id) for i, q in enumerate(asked)], f"query long, item_id {queries.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best rows of ``docs`` (doc_id, text, ...) for each row of ``queries`` (item_id, text, ...).

    Returns item_id, rank, doc_id, score.  Equal scores go by ascending
    doc_id, null ids last; documents of score 0 are not listed.  A row that is
    repeated, on either side, counts as often as it stands.  Null and empty
    texts have no terms; no documents, or no queries, give no rows.  A very
    long text is split a megabyte at a time.  Other columns are left aside.

    Queries are taken in passes of about ``PASS_TERMS`` terms, so that what is
    on the driver and in the workers does not grow with them.
    """
    queries = queries.select("item_id", "text")
    passes = partitions_for(queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 4, PASS_TERMS)
    if passes == 1:
        return _search_pass(docs, queries, k)
    dealt = cut(queries.withColumn("_pass", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(passes))))
    out = None
    for i in range(passes):
        found = _search_pass(docs, dealt.where(F.col("_pass") == i).drop("_pass"), k)
        out = found if out is None else out.unionByName(found)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
item AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
all_ AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM item) GROUP BY q, t),
tf AS MATERIALIZED (SELECT r, n, t, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS t FROM doc) SEMI JOIN asked USING (t) GROUP BY r, n, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * all_.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, all_ GROUP BY t, all_.n),
impact AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * all_.n) // all_.l))) AS x FROM tf JOIN weight USING (t), all_),
score AS (SELECT q, r, CAST(sum(x * times) AS BIGINT) AS score FROM asked JOIN impact USING (t) GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score JOIN item USING (q) JOIN doc USING (r) WHERE score > 0)
WHERE rank <= {K}
"""
