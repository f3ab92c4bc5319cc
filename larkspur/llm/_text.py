"""Words and rolling hashes of whole texts, a few megabytes at a time.

All functions work on the UTF-8 bytes of many texts at once.  A chunk holds
about ``CHUNK_BYTES`` of text (one longer text makes a chunk of its own), so
memory is bounded by the longest text and not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C55)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z, non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(_inverse(self.base), size)
        return self.up[:n], self.down[:n]


_BYTES, _SEQ_A, _SEQ_B = _Powers(int(_BASE)), _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a list of texts (bytes or None), by byte classes."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool):
        joined = b" ".join(t or b"" for t in texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = _LOWER[data]
        self.n_docs, self.data = len(texts), data
        is_word = table[data]
        edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        #: index of the first word of each text, and one more
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)  # of each byte in its word
        up, _ = _BYTES.get(int(size.max()))
        values = self.data[place + np.repeat(self.start, size)].astype(np.uint64)
        values += np.uint64(1)
        values *= up[place]
        return mix(np.add.reduceat(values, first))

    def prefix_hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """The hash of the first k bytes of the words at ``at``, which have as many."""
        start, (up, _) = self.start[at], _BYTES.get(k)
        total = np.zeros(len(start), np.uint64)
        for j in range(k):
            total += (self.data[start + j].astype(np.uint64) + np.uint64(1)) * up[j]
        return mix(total)

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of one text by ``ALNUM``."""
        words = Words([text.encode()], ALNUM, lower=True)
        raw = words.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(words.start.tolist(), words.end.tolist())]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (not included), joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries (those that cross texts included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 12:
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_SEQ_A.base) + words[j : j + n]
        return mix(out, k)
    return mix(_rolling(words, k, _SEQ_A), k)


def grams_pair(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each k consecutive entries."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return mix(_rolling(words, k, _SEQ_A), k), mix(_rolling(mix(words, 7), k, _SEQ_B), k + 1)


def _rolling(words: np.ndarray, k: int, powers: _Powers) -> np.ndarray:
    up, down = powers.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    n = len(words) - k + 1
    return (total[k:] - total[:n]) * down[:n]


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the entries from start to end, of any lengths."""
    out = []
    for values, powers in ((words, _SEQ_A), (mix(words, 7), _SEQ_B)):
        up, down = powers.get(len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


def window_argmin(values: np.ndarray, width: int, rightmost: bool) -> np.ndarray:
    """Index of the minimum of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order = range(width - 1, -1, -1) if rightmost else range(width)
    first = order[0]
    best, at = values[first : first + n].copy(), np.full(n, first, np.int32)
    for j in order[1:]:
        here = values[j : j + n]
        less = here < best
        np.copyto(best, here, where=less)
        at[less] = j
    return at + np.arange(n)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, at: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at most ``limit`` bytes of text (column ``at`` or of that name) or one row."""
    where = at
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column) if where is None else where))
        total = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


import pyarrow.compute  # noqa: E402  chunks() uses pa.compute
