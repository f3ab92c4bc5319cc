"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids are cut into pieces of *reciprocal* sizes ``capacity // j``:
first whole sequences (j = 1), then greedily the largest such size that still
fits the rest, as in an Egyptian fraction, so that a tail of any length takes
two or three cuts.  Class j's bins always hold exactly j pieces, and a full bin
wastes ``capacity % j`` places at most.  Every worker fills the bins of its own
partition, with no exchange; what is left in its open bins at the end is
concatenated and cut into sequences of ``capacity`` and of powers of two.

Ids are those of the public byte-level BPE.  They are computed by a faster
implementation of the same merges (a test holds the two together); texts that
contain the tokenizer's special token go through the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import map_arrow, table
from larkspur.llm._text import chunks

CAPACITY, END_ID = 2048, 1

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to ids exactly as the tokenizer file does, without special tokens added."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = _byte_of_char()
        ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self._slow = Tokenizer.from_file(path)
        self._fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.special):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


def cuts(n: int, capacity: int) -> list[int]:
    """Sizes of the pieces of n ids: each is ``capacity // j`` for some j."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        size = capacity // -(-capacity // n)  # the largest reciprocal size that fits
        out.append(size)
        n -= size
    return out


class HarmonicPacker:
    """Open bins of one worker; ``add`` and ``close`` return the pieces of bins that are full."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _seal(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for doc_id, start, ids, doc_tokens in pieces:
            out.append((doc_id, start, ids, doc_tokens, self.next, at))
            at += len(ids)
        self.next += 1
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        for size in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(size, [])
            bin_.append((doc_id, start, ids[start : start + size], len(ids)))
            start += size
            if len(bin_) == self.capacity // size:
                out += self._seal(self.open.pop(size))
        return out

    def close(self) -> list[tuple]:
        rest = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        total, out = sum(len(p[2]) for p in rest), []
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        pieces = iter(rest)
        piece = None
        for size in room:
            held: list[tuple] = []
            while size:
                doc_id, start, ids, n = piece or next(pieces)
                take = min(size, len(ids))
                held.append((doc_id, start, ids[:take], n))
                piece = (doc_id, start + take, ids[take:], n) if take < len(ids) else None
                size -= take
            out += self._seal(held)
        return out


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, seq, at = zip(*pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())],
        schema=_ARROW,
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text, and any other columns) into sequences.

    Returns one row per piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.  A null or empty text is
    the end id alone.  Rows with null or repeated doc_ids are packed like all
    others, each row as a document of its own.  An empty table gives no rows.
    ``docs`` has to be recomputed alike after a lost executor, as scans are:
    sequence ids are the partition's number and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        held: list[tuple] = []
        for batch in chunks(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += packer.add(doc_id, np.append(encode(text), np.uint32(end_id)))
            if len(held) > 2000:
                yield _batch(held)
                held = []
        held += packer.close()
        if held:
            yield _batch(held)

    return map_arrow(docs.select("doc_id", "text"), run, _SCHEMA)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; one row per piece with a checksum of its ids."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
