"""Removal of word windows that stand in more than one place.

Windows of 35 words are grouped by their minimiser, the least hash of six
consecutive words in the window.  Consecutive windows with the same minimiser
travel as one packed string (a super-k-mer) to the minimiser's bucket, where
the windows of all strings are sorted and counted.  Before the exchange each
chunk of texts merges equal strings: windows of a string that the chunk holds
twice are known to repeat, so one copy goes out, marked as several, and the
others are answered on the spot.  However often a passage stands in the
corpus, a bucket gets it once from each chunk.

Windows are compared by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import partitions_for, row_key, table
from larkspur.llm._text import NOT_SPACE, Words, as_bytes, chunks, grams, grams_pair, mix, span_hashes, window_argmin

WINDOW, MINIMISER = 35, 6
BUCKET_BYTES = 12_000_000
#: Text whose equal strings are merged before the exchange.
PACK_BYTES = 4_000_000
#: A window's words travel about so many times in super-k-mers of these sizes.
_SPREAD = 3

_META = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("many", "<i4")])
_SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("span", "<i8")])
_PACKED = "bucket long, texts binary, meta binary, known binary"


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, closer: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after another, each with its last byte set to ``closer``, and where each ends."""
    size = end - start
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)
    out = data[at]
    out[stop - 1] = closer
    return out, stop


def _cover(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words lie in windows that start at ``at``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:n]) > 0


def _spans(words: Words | _Counts, cover: np.ndarray, k1: np.ndarray, k2: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Covered runs as rows of key and start * 2^32 + end, by text; base: the number of each text's first word."""
    turn = np.ones(len(words) + 1, bool)
    turn[1:-1] = (words.doc[1:] != words.doc[:-1]) | (cover[1:] != cover[:-1])
    start, end = np.flatnonzero(turn[:-1] & cover), np.flatnonzero(turn[1:] & cover) + 1
    d = words.doc[start]
    out = np.zeros(len(start), _SPAN)
    out["k1"], out["k2"] = k1[d], k2[d]
    out["span"] = ((start - words.first[d] + base[d]) << 32) + (end - words.first[d] + base[d])
    return out


def _pack(window: int, minimiser: int, buckets: int):
    """Texts to packed super-k-mers by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches, limit=PACK_BYTES):
            words = Words(as_bytes(batch.column(2)), NOT_SPACE, lower=False)
            n = len(words) - window + 1
            if n <= 0:
                continue
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            plain = np.where(NOT_SPACE[words.data], words.data, np.uint8(32))  # a line break closes a string
            h = words.hashes()
            g = grams(h, minimiser)
            at = window_argmin(g, window - minimiser + 1, rightmost=False)
            inside = words.doc[:n] == words.doc[window - 1 :]
            new = np.ones(n, bool)
            new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
            first = np.flatnonzero(new & inside)
            if not len(first):
                continue
            breaks = np.append(np.flatnonzero(new | ~inside), n)
            last = breaks[np.searchsorted(breaks, first, side="right")]  # first window after the run
            end = last + window - 1  # first word after the string
            a, b = span_hashes(h, first, end)
            order = np.lexsort((b, a))
            same = np.zeros(len(order), bool)
            same[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            count = np.bincount(leader, minlength=len(order))
            many = np.zeros(len(order), bool)
            many[order] = count[leader] > 1
            sent = np.ones(len(order), bool)
            sent[order] = ~same
            known = b""
            if many.any():
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, first[many], 1)
                np.add.at(step, end[many], -1)
                known = zip_.compress(_spans(words, np.cumsum(step[:-1]) > 0, k1, k2, np.zeros(words.n_docs, np.int64)).tobytes())
            pick = np.flatnonzero(sent)
            where = (mix(g[at[first[pick]]], 5) % np.uint64(buckets)).astype(np.int64)
            pick, where = pick[(by := np.argsort(where, kind="stable"))], where[by]
            d = words.doc[first[pick]]
            meta = np.zeros(len(pick), _META)
            meta["k1"], meta["k2"], meta["start"], meta["many"] = k1[d], k2[d], first[pick] - words.first[d], many[pick]
            ids, begin = np.unique(where, return_index=True)
            out: list[list] = [[], [], [], []]
            for bucket, lo, hi in zip(ids.tolist(), begin.tolist(), [*begin[1:].tolist(), len(pick)]):
                text, _ = _gather(plain, words.start[first[pick[lo:hi]]], words.end[end[pick[lo:hi]] - 1] + 1, 10)
                out[0].append(bucket), out[1].append(zip_.compress(text.tobytes())), out[2].append(meta[lo:hi].tobytes()), out[3].append(b"")
            if known:
                out[0].append(int(k1[0]) % buckets), out[1].append(b""), out[2].append(b""), out[3].append(known)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "texts", "meta", "known"])

    return run


def _records(table_: pa.Table) -> Iterator[tuple[Words, np.ndarray]]:
    """A bucket's strings, one packed blob at a time."""
    unzip = zstandard.ZstdDecompressor()
    for blob, meta in zip(table_.column("texts"), table_.column("meta")):
        if raw := blob.as_py():
            yield unzip.decompress(raw), np.frombuffer(meta.as_py(), _META)


def _count(window: int):
    """A bucket's windows, counted; the spans of repeated ones."""

    def run(table_: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        held, pairs_a, pairs_b, weights, places = [], [], [], [], []
        for raw, meta in _records(table_):
            words = Words(raw.split(b"\n")[: len(meta)], NOT_SPACE, lower=False)
            n = len(words) - window + 1
            a, b = grams_pair(words.hashes(), window)
            at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
            pairs_a.append(a[at]), pairs_b.append(b[at])
            weights.append(1 + meta["many"][words.doc[at]])
            places.append(at)
            held.append((words.counts, meta))
        spans = [np.frombuffer(unzip.decompress(x), _SPAN) for x in table_.column("known").to_pylist() if x]
        if held:
            a, b, weight = map(np.concatenate, (pairs_a, pairs_b, weights))
            order = np.lexsort((b, a))
            first = np.ones(len(order), bool)
            first[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            group = np.cumsum(first) - 1
            repeated = np.zeros(len(order), bool)
            repeated[order] = np.bincount(group, weights=weight[order])[group] > 1
            lo = 0
            for (counts, meta), at in zip(held, places):
                twice = at[repeated[lo : lo + len(at)]]
                lo += len(at)
                if len(twice):
                    words = _Counts(counts)
                    cover = _cover(twice, len(words), window) & (meta["many"][words.doc] == 0)
                    spans.append(_spans(words, cover, meta["k1"], meta["k2"], meta["start"].astype(np.int64)))
        all_ = np.concatenate(spans) if spans else np.zeros(0, _SPAN)
        return pa.table({x: pa.array(np.ascontiguousarray(all_[x])) for x in ("k1", "k2", "span")})

    return run


class _Counts:
    """Where texts begin in a row of words, from their word counts."""

    def __init__(self, counts: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def __len__(self) -> int:
        return int(self.first[-1])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans -> doc_id, n_words, n_removed, kept."""
    for batch in chunks(batches):
        words = Words(as_bytes(batch.column(1)), NOT_SPACE, lower=False)
        spans = batch.column(2)
        step = np.zeros(len(words) + 1, np.int32)
        owner = np.repeat(np.arange(batch.num_rows), np.nan_to_num(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False).astype(float)).astype(int))
        flat = spans.flatten().to_numpy()
        np.add.at(step, words.first[owner] + (flat >> 32), 1)
        np.add.at(step, words.first[owner] + (flat & 0xFFFFFFFF), -1)
        keep = np.cumsum(step[:-1]) == 0
        kept = np.bincount(words.doc[keep], minlength=batch.num_rows)
        text, stop = _gather(words.data, words.start[keep], words.end[keep] + 1, 32)
        ends = np.concatenate(([0], stop))[np.cumsum(kept)]
        raw, out, lo = text.tobytes(), [], 0
        for hi in ends.tolist():
            out.append(raw[lo : max(lo, hi - 1)])
            lo = hi
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts, pa.int64()), pa.array(words.counts - kept, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """Removes every word of ``docs`` (doc_id, text, ...) in a window that stands elsewhere too.

    Words are runs of anything but white space.  Windows are judged on the
    input as it is, in the same document as well as between documents.  Returns
    per row doc_id, n_words, n_removed and kept, the other words joined by one
    space.  Null and empty texts have no words; texts shorter than a window
    keep all; rows that repeat an id and a text count as places of their own
    and get the same result; ids may be null.
    """
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions_for(total * _SPREAD, BUCKET_BYTES)
    packed = keyed.select("_k1", "_k2", "text").mapInArrow(_pack(window, minimiser, buckets), _PACKED)
    spans = packed.groupBy("bucket").applyInArrow(_count(window), "k1 long, k2 long, span long")
    by_doc = spans.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set("span").alias("spans"))  # rows that repeat id and text have equal spans
    joined = keyed.join(by_doc, ["_k1", "_k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those removed, and a digest of the rest."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
