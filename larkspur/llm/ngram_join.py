"""Similarity join of documents on the Jaccard index of their word shingles.

Prefix filtering with the rarest shingles first: two sets of Jaccard index t or
more share one of each other's first n - ceil(t n) + 1 shingles in any common
order.  The order is by frequency over all documents, from counts in 2^20
slots of fixed size (a consistent order is all that the filter needs), then by
hash.  Steps:

1. One pass gives each document's set size and two order-free 64-bit sums of
   its shingles; documents with equal sets are one *class*, and only classes
   are joined.  The same pass counts shingles.
2. Prefix shingles are packed by shingle bucket; each bucket sorts them and
   yields the posting lists of two or more classes, each once and with how many
   shingles have it.  Summed over the lists of a class, that tells how many of
   its prefix shingles it shares with any other.  Of two sets, let x be
   the one whose prefix ends first in the common order: all that x's prefix has
   in common with y stands in y's prefix.  So their overlap is at most x's
   *room*, its size less the shingles of its prefix that no other prefix has.
3. In each list, members of compatible length are paired with one *hub*, the
   one with the fewest shingles of its own, and the pairs are verified on whole
   texts.  A group of copies of any size is so joined by about as many pairs as
   it has members.
4. All other pairs of a list whose members are in different components by now,
   and that pass the length, room, positional and bitmap filters, are verified
   too, so that no link is lost that could join two components.  The bitmap has
   one bit a hash range, set where the set has an odd number of shingles; two
   sets differ in at least as many shingles as their bitmaps in bits, which
   bounds their overlap.

Verification applies a suffix filter (sizes of 16 hash ranges of the two sets
bound their overlap) before it counts the overlap, once for each pair.  Pairs
are dealt by the member that stands in most of them, ``EACH`` to a group: its
text comes once to each group and not once to each pair.  A posting list of
more than about ``HOT`` classes is dealt to parts by class, and each two parts
meet in a task of their own, as do each two blocks of ``BLOCK`` members of a
list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm._graph import components
from larkspur.llm._spark import bounded_batches, cut, give_back, map_arrow, partitions_for, row_key, table
from larkspur.llm._text import NOT_SPACE, Words, as_bytes, chunks, grams, mix

SHINGLE, PERCENT = 5, 75
COUNT_BITS, KEY_BITS = 20, 23
BUCKET_TUPLES = 600_000
#: A shingle that so many documents more than usual hold is dealt to several parts.
HOT = 100_000
#: Members of a list that are compared with as many others in one step; the blocks of a longer list meet in pairs.
BLOCK = 2048
#: Pairs that share the text of their hub.
EACH = 256

_TUPLE = np.dtype([("g", "<u8"), ("c", "<u8"), ("n", "<u4"), ("pos", "<u2"), ("parts", "<u2")])
_LISTS = "shingle long, part int, times long, codes array<long>, sizes array<long>"
#: Bits of a set's bitmap: four a shingle, a power of two between these.
BITS = (256, 4096)

#: The part of rows that hold where the prefixes of a bucket's classes end.
_ENDS = -1


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct shingle, in order of both."""
    words = Words(texts, NOT_SPACE, lower=True)
    h, docs, out = words.hashes(), [], []
    for k in range(1, size + 1):
        if len(h) < k:
            break
        ok = words.doc[: len(h) - k + 1] == words.doc[k - 1 :]
        if k < size:  # a shorter text is one shingle
            ok &= words.counts[words.doc[: len(h) - k + 1]] == k
            if not ok.any():
                continue
        docs.append(words.doc[: len(ok)][ok])
        out.append(grams(h, k)[ok])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, g = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _survey(size: int, id_type: pa.DataType):
    """Texts to set sizes and sums; then the partition's shingle counts, 16 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)

        def rows(ids, n, a, b, part, blob):
            return pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["doc_id", "_k1", "_k2", "n", "c", "c2", "part", "blob"])

        for batch in chunks(batches):
            doc, g = shingle_sets(as_bytes(batch.column(3)), size)
            counts += np.bincount(g >> np.uint64(64 - COUNT_BITS), minlength=len(counts))
            m = batch.num_rows
            a, b = _sums(doc, mix(g, 11), m), _sums(doc, mix(g, 12), m)
            yield rows(batch.columns[:3], np.bincount(doc, minlength=m), mix(a ^ mix(b, 13)).view(np.int64), b.view(np.int64), [None] * m, [None] * m)
        parts = counts.reshape(16, -1)
        none = [None] * 16
        yield rows([pa.nulls(16, id_type), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64())], none, none, none, range(16), [zstandard.compress(x.tobytes(), 1) for x in parts])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(zstandard.decompress(blob), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "blob"])


def _shingle_counts(surveyed: DataFrame) -> np.ndarray:
    """The counts of all partitions, summed by slot in two steps; 8 MB whatever the input."""
    rows = surveyed.where("part IS NOT NULL").select("part", "blob")
    some = map_arrow(rows.repartition(64, "part", F.xxhash64("blob") % 4), _add_counts, "part int, blob binary")
    parts = map_arrow(some.repartition(16, "part"), _add_counts, "part int, blob binary").collect()
    out = np.zeros((16, (1 << COUNT_BITS) // 16), np.int64)
    for part, blob in parts:
        out[part] += np.frombuffer(zstandard.decompress(bytes(blob)), np.int64)
    return out.reshape(-1)


def _order_key(often: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A number that grows with the common order; equal numbers leave the order open."""
    most = (1 << 20) - 1
    return np.where(often < most, (np.minimum(often, most).astype(np.uint64) << np.uint64(42)) + (g >> np.uint64(22)), np.uint64(most << 42))


def _prefixes(size: int, percent: int, buckets: int, counts, hot: int):
    """Texts to the prefix shingles of their sets, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = counts.value
        usual = int(np.median(frequent))
        for batch in chunks(batches):
            m = batch.num_rows
            doc, g = shingle_sets(as_bytes(batch.column(0)), size)
            c = mix(_sums(doc, mix(g, 11), m) ^ mix(_sums(doc, mix(g, 12), m), 13))
            n = np.bincount(doc, minlength=m)
            _, first = np.unique(c, return_index=True)  # equal sets once a chunk
            lead = np.zeros(m, bool)
            lead[first] = True
            doc, g = doc[lead[doc]], g[lead[doc]]
            often = frequent[g >> np.uint64(64 - COUNT_BITS)]
            order = np.lexsort((g, often, doc))
            doc, g, often = doc[order], g[order], often[order]
            pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
            within = pos < _prefix(n[doc], percent)
            doc, g, often, pos = doc[within], g[within], often[within], pos[within]
            if not len(doc):
                continue
            parts = np.minimum(1 + np.maximum(often - usual, 0) // hot, 60_000)
            where = mix(g + (c[doc] % parts.astype(np.uint64)), 3) % np.uint64(buckets)
            by = np.argsort(where, kind="stable")
            out = np.zeros(len(by), _TUPLE)
            out["g"], out["c"], out["n"], out["pos"], out["parts"] = g[by], c[doc][by], n[doc][by], np.minimum(pos[by], 65_535), parts[by]
            last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
            ends = np.zeros(len(last), _TUPLE)  # parts 0: where the class's prefix ends
            ends["g"], ends["c"] = _order_key(often[last], g[last]), c[doc[last]]
            out = np.concatenate([out, ends])
            where = np.concatenate([where[by], ends["c"] % np.uint64(buckets)])
            by = np.argsort(where, kind="stable")
            out, where = out[by], where[by]
            ids, begin = np.unique(where, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([out[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(out)])], pa.binary())], names=["bucket", "tuples"])

    return run


def _posting_lists(table_: pa.Table) -> pa.Table:
    """A bucket's lists of two classes or more: members, and for lists dealt to several tasks the shingle and part.

    Equal lists come out once, with the number of their shingles.  A part of a
    dealt list comes out even with one member, for its hub.  One row more has
    the ends of prefixes.
    """
    t = np.frombuffer(b"".join(table_.column("tuples").to_pylist()), _TUPLE)
    ends = t[t["parts"] == 0]
    t = t[t["parts"] > 0]
    part = t["c"] % t["parts"]
    order = np.lexsort((t["c"], part, t["g"]))
    t, part = t[order], part[order]
    head = np.ones(len(t), bool)
    head[1:] = (t["g"][1:] != t["g"][:-1]) | (part[1:] != part[:-1])
    new = head.copy()
    new[1:] |= t["c"][1:] != t["c"][:-1]
    t, part, head = t[new], part[new], head[new]  # a class that several chunks sent counts once
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, len(t)))
    keep = (length > 1) | (t["parts"][begin] > 1)
    codes, sizes = t["c"].astype(np.int64), (t["n"].astype(np.int64) << 32) + t["pos"]
    out: dict[tuple, tuple] = {}
    times: Counter[tuple] = Counter()
    for lo, k in zip(begin[keep].tolist(), length[keep].tolist()):
        dealt = bool(t["parts"][lo] > 1)
        g = int(t["g"][lo].astype(np.int64)) if dealt else None
        x = codes[lo : lo + k]
        key = g, int(part[lo]) if dealt else 0, x.tobytes()
        out.setdefault(key, (x, sizes[lo : lo + k]))  # each list's places bound the overlap
        times[key] += 1
    _, one = np.unique(ends["c"], return_index=True)
    out[None, _ENDS, b""] = (ends["c"][one].astype(np.int64), ends["g"][one].astype(np.int64))
    ends = np.cumsum([0] + [len(x) for x, _ in out.values()]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v[i] for v in out.values()]).astype(np.int64))) for i in (0, 1)]
    return pa.table({"shingle": pa.array([k[0] for k in out], pa.int64()), "part": pa.array([k[1] for k in out], pa.int32()), "times": pa.array([times[k] for k in out], pa.int64()), "codes": lists[0], "sizes": lists[1]})


def _lean_lists(table_: pa.Table) -> pa.Table:
    """``_posting_lists``; what a bucket took goes back before the next."""
    out = _posting_lists(table_)
    give_back()
    return out


def _prefix(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


@dataclass
class Members:
    """A posting list's classes with their sizes, places of the shingle, rooms and ends of prefixes."""

    c: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    room: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, codes: list[int], sizes: list[int], known: list[dict], percent: int) -> Members:
        c, x = np.array(codes, np.int64), np.array(sizes, np.int64)
        n = x >> 32
        room = n - _prefix(n, percent) + np.array([k["shared"] for k in known], np.int64)
        return cls(c, n, x & 0xFFFFFFFF, room, np.array([k["end"] for k in known], np.int64))

    def take(self, at: np.ndarray) -> Members:
        return Members(self.c[at], self.n[at], self.pos[at], self.room[at], self.end[at])


def hubs(m: Members, percent: int) -> np.ndarray:
    """For each member the index of its hub: in a run of compatible lengths, the one with the fewest shingles of its own."""
    order = np.argsort(m.n, kind="stable")
    n = m.n[order]
    out, at = np.zeros(len(n), np.int64), 0
    while at < len(n):
        to = int(np.searchsorted(n, n[at] * 100 // percent, side="right"))
        run = order[at:to]
        out[run] = run[np.lexsort((m.c[run], m.n[run] - m.room[run]))[0]]
        at = to
    return out


def _hub_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for codes, sizes, known in zip(*(batch.column(i).to_pylist() for i in range(3))):
                m = Members.of(codes, sizes, known, percent)
                hub = hubs(m, percent)
                other = np.flatnonzero(hub != np.arange(len(hub)))
                x, y = m.take(hub[other]), m.take(other)
                ok = _may_link(x, y, percent)
                a.append(x.c[ok]), b.append(y.c[ok])
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return run


def _may_link(x: Members, y: Members, percent: int) -> np.ndarray:
    """Length, room and positional filters: can sets that share a shingle at these places overlap enough?"""
    room = np.where(x.end < y.end, x.room, np.where(y.end < x.end, y.room, np.maximum(x.room, y.room)))
    place = np.minimum(x.pos, y.pos) + 1 + np.minimum(x.n - x.pos - 1, y.n - y.pos - 1)
    most = np.minimum(np.minimum(room, place), np.minimum(x.n, y.n))
    return (100 * most >= percent * (x.n + y.n - most)) & (100 * np.minimum(x.n, y.n) >= percent * np.maximum(x.n, y.n))


def bitmaps(texts: list[bytes | None], size: int = SHINGLE) -> list[bytes]:
    """For each text its set's bitmap; a bitmap of half the bits is the exclusive or of the halves."""
    doc, g = shingle_sets(texts, size)
    n = np.bincount(doc, minlength=len(texts))
    bits = 1 << np.ceil(np.log2(np.clip(4 * n, *BITS))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(bits)))
    at = begin[doc] + (mix(g, 17) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return [odd[a // 8 : b // 8].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _bitmaps(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bitmaps(as_bytes(batch.column(1)), size), pa.binary())], names=["c", "bitmap"])

    return run


class Bitmaps:
    """The bitmaps of a list's members, each also in the sizes below its own."""

    def __init__(self, of: list[bytes]):
        self.words = np.array([len(b) // 8 for b in of], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place, rows = np.zeros(len(of), np.int64), np.zeros((0, 0), np.uint64)
        for w in sorted(set(self.words.tolist()), reverse=True):
            own = np.flatnonzero(self.words == w)
            while rows.shape[1] > w:
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            place = place.copy()
            place[own] = len(rows) + np.arange(len(own))
            mine = np.frombuffer(b"".join(of[i] for i in own), np.uint64).reshape(len(own), w)
            rows = np.concatenate([rows, mine]) if len(rows) else mine
            self.rows[w] = place, rows

    def __getitem__(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and rows at ``w`` words, for all members of so many or more."""
        if w not in self.rows:
            place, rows = self.rows[min(x for x in self.rows if x > w)]
            while rows.shape[1] > w:
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            self.rows[w] = place, rows
        return self.rows[w]


def differing(x: Bitmaps, i: np.ndarray, y: Bitmaps, j: np.ndarray) -> np.ndarray:
    """In how many bits member i[k] of x and j[k] of y differ, each pair at the smaller of their sizes."""
    out, words = np.zeros(len(i), np.int64), np.minimum(x.words[i], y.words[j])
    for w in np.unique(words).tolist():
        (at_x, rows_x), (at_y, rows_y) = x[w], y[w]
        pairs = np.flatnonzero(words == w)
        step = (1 << 20) // w
        for k in range(0, len(pairs), step):
            p = pairs[k : k + step]
            out[p] = np.bitwise_count(rows_x[at_x[i[p]]] ^ rows_y[at_y[j[p]]]).sum(1, dtype=np.int64)
    return out


def _cross_pairs(percent: int, two: bool):
    """Members, their components and bitmaps (of one list, or of two parts of a list) to the pairs that hubs left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, cx = Members.of(row["codes"], row["sizes"], row["known"], percent), np.array(row["roots"], np.int64)
                y, cy = (Members.of(row["codes2"], row["sizes2"], row["known2"], percent), np.array(row["roots2"], np.int64)) if two else (x, cx)
                bx = Bitmaps(row["bitmap"])
                by = Bitmaps(row["bitmap2"]) if two else bx
                hub = None if two else hubs(x, percent)
                step = max(1, 500_000 // len(cy))
                for at in range(0, len(cx), step):
                    i, j = np.nonzero(cx[at : at + step, None] != cy[None])
                    i += at
                    left, right = x.take(i), y.take(j)
                    ok = _may_link(left, right, percent)
                    if not two:
                        ok &= (i < j) & (hub[i] != j) & (hub[j] != i)
                    i, j = i[ok], j[ok]
                    total = x.n[i] + y.n[j]
                    most = (total - differing(bx, i, by, j)) // 2
                    ok = 100 * most >= percent * (total - most)
                    a, b = x.c[i[ok]], y.c[j[ok]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def verify(size: int, percent: int):
    """Rows (hub, member, text), a hub's own text with a null member before its members, to the pairs whose sets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bytes | None] = (0, b"")  # the hub that the last chunk ended with
        for batch in chunks(batches):
            hub_ids, texts = batch.column(0).to_numpy(), [held[1], *as_bytes(batch.column(2))]
            is_hub = np.concatenate([[True], batch.column(1).is_null().to_numpy(zero_copy_only=False)])
            hub = np.maximum.accumulate(np.where(is_hub, np.arange(len(is_hub)), 0))
            held = int(hub_ids[-1]), texts[hub[-1]]
            doc, g = shingle_sets(texts, size)
            n = np.bincount(doc, minlength=len(texts))
            # suffix filter: the sets differ at least by the differences of their parts' sizes
            parts = np.bincount(doc * 16 + (g >> np.uint64(60)).astype(np.int64), minlength=16 * len(texts)).reshape(-1, 16)
            most = np.minimum(parts, parts[hub]).sum(1)
            left = ~is_hub & (100 * most >= percent * (n + n[hub] - most))
            owner = mix(hub.astype(np.uint64), 21)
            of_hub, of_member = is_hub[doc], left[doc]
            keys = np.sort(mix(g[of_hub] + owner[doc[of_hub]]))
            mine = mix(g[of_member] + owner[doc[of_member]])
            at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            both = np.bincount(doc[of_member][keys[at] == mine] if len(keys) else np.zeros(0, int), minlength=len(texts))
            ok = (left & (both > 0) & (100 * both >= percent * (n + n[hub] - both)))[1:]
            a, b = hub_ids[ok], batch.column(1).filter(pa.array(ok)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def similar(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """Groups the rows of ``docs`` (doc_id, text, ...) by links of a Jaccard index of ``percent`` or more.

    Returns per row doc_id, _k1, _k2 (its content key), n_shingles,
    component_id, the least doc_id that its links reach, itself included, and
    group, a number of the component.  Null, empty and wordless texts have no
    shingles, no links and a null group.  Texts of any length are read whole.
    Rows that repeat a text are one class, whatever their ids; null ids are
    passed over for component_id unless a group has no other.  Other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    id_field = docs.schema["doc_id"]
    surveyed = cut(map_arrow(keyed, _survey(size, to_arrow_type(id_field.dataType)), f"doc_id {id_field.dataType.simpleString()}, _k1 long, _k2 long, n int, c long, c2 long, part int, blob binary"))
    rows = surveyed.where("part IS NULL").select("doc_id", "_k1", "_k2", "n", "c", "c2")
    counts = spark.sparkContext.broadcast(_shingle_counts(surveyed))
    tuples = rows.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0

    packed = map_arrow(docs.select("text"), _prefixes(size, percent, partitions_for(tuples, BUCKET_TUPLES), counts, hot), "bucket long, tuples binary")
    bounded_batches(spark)
    found = cut(packed.groupBy("bucket").applyInArrow(_lean_lists, _LISTS))
    counts.destroy()

    once = cut(found.where("part >= 0").groupBy("shingle", "part", "codes").agg(F.first("sizes").alias("sizes"), F.sum("times").alias("times")))
    shared = once.select("times", F.explode("codes").alias("c")).groupBy("c").agg(F.sum("times").alias("shared"))
    ends = found.where(F.col("part") == _ENDS).select(F.explode(F.arrays_zip("codes", "sizes")).alias("x")).select(F.col("x.codes").alias("c"), F.col("x.sizes").alias("end"))
    known = shared.join(ends, "c").select("c", F.struct("shared", "end").alias("known"))
    lists = cut(_attached(once.drop("times"), known, "known"))
    # the first members of the parts of a dealt list make a list of their own
    heads = lists.where("shingle IS NOT NULL").groupBy("shingle").agg(F.array_sort(F.collect_set(F.struct(F.col("codes")[0].alias("c"), F.col("sizes")[0].alias("s"), F.col("known")[0].alias("k")))).alias("m"))
    heads = heads.select(F.col("m.c").alias("codes"), F.col("m.s").alias("sizes"), F.col("m.k").alias("known"))
    paired = lists.select("codes", "sizes", "known").unionByName(heads).where(F.size("codes") > 1)
    pairs = cut(map_arrow(paired, _hub_pairs(percent), "a long, b long").distinct())
    texts = _class_texts(keyed, rows, lists)
    links = cut(_verified(pairs, texts, size, percent))
    roots = components(links)

    named = _attached(lists, roots.select(F.col("node").alias("c"), "root"), "root").withColumn("roots", F.transform("root", lambda x, i: F.coalesce(x, F.col("codes")[i])))
    labelled = cut(named.withColumn("k", F.size(F.array_distinct("roots"))).where("k > 1 OR shingle IS NOT NULL"))
    compared = texts.join(labelled.select(F.explode("codes").alias("c")).distinct(), "c", "left_semi")
    labelled = cut(_attached(labelled, map_arrow(compared.select("c", "text"), _bitmaps(size), "c long, bitmap binary"), "bitmap"))
    mine = ["codes", "sizes", "known", "roots", "bitmap"]
    theirs = [f"{name}2" for name in mine]
    more = map_arrow(labelled.where(f"k > 1 AND size(codes) <= {BLOCK}").select(*mine), _cross_pairs(percent, False), "a long, b long")
    # the blocks of a long list, each two of them under a key of their own
    cut_at = ", ".join(f"slice({x}, i * {BLOCK} + 1, {BLOCK}) AS {x}" for x in mine)
    long = labelled.where(f"k > 1 AND size(codes) > {BLOCK}").withColumns({"list": F.struct(F.xxhash64("shingle", "part", "codes"), F.hash("codes", "part", "shingle")), "blocks": F.expr(f"(size(codes) - 1) div {BLOCK} + 1")})
    blocks = long.select("list", "blocks", F.expr(f"explode(transform(sequence(0L, blocks - 1), i -> struct(i, {cut_at}))) AS x"))
    first = blocks.select("list", F.col("x.i").alias("lo"), F.expr("explode(sequence(x.i, blocks - 1))").alias("hi"), *[F.col(f"x.{a}").alias(a) for a in mine])
    second = blocks.select("list", F.col("x.i").alias("hi"), F.expr("explode(sequence(0L, x.i))").alias("lo"), *[F.col(f"x.{a}").alias(b) for a, b in zip(mine, theirs)])
    met = first.join(second, ["list", "lo", "hi"]).select(*mine, *theirs)
    more = more.unionByName(map_arrow(met, _cross_pairs(percent, True), "a long, b long"))
    dealt = labelled.where("shingle IS NOT NULL")
    dealt = dealt.join(dealt.groupBy("shingle").agg((F.max("part") + 1).alias("parts")), "shingle")
    # each two parts of a list meet under a key of their own
    before = dealt.where("part > 0").select("shingle", F.col("part").alias("hi"), F.explode(F.expr("sequence(0, part - 1)")).alias("lo"), *[F.col(a).alias(b) for a, b in zip(mine, theirs)])
    after = dealt.where("part < parts - 1").select("shingle", F.col("part").alias("lo"), F.explode(F.expr("sequence(part + 1, parts - 1)")).alias("hi"), "k", *mine)
    across = after.join(before, ["shingle", "lo", "hi"]).where("k > 1 OR exists(roots2, x -> x <> roots[0])")
    more = more.unionByName(map_arrow(across.select(*mine, *theirs), _cross_pairs(percent, True), "a long, b long"))
    late = cut(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        roots = components(links.unionByName(_verified(late, texts, size, percent)))

    classes = rows.where("n > 0").groupBy("n", "c", "c2").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left")
    linked = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("reached"))
    rooted = rooted.join(linked, "root", "left").select("n", "c", "c2", F.coalesce("reached", "least").alias("component_id"), F.coalesce("root", "c").alias("group"))
    return rows.join(rooted, ["n", "c", "c2"], "left").select("doc_id", "_k1", "_k2", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def _class_texts(keyed: DataFrame, rows: DataFrame, lists: DataFrame) -> DataFrame:
    """c and text of the classes that stand in a list, one row each."""
    wanted = lists.select(F.explode("codes").alias("c")).distinct()
    one = cut(rows.groupBy("c").agg(F.min(F.struct("_k1", "_k2")).alias("k")).join(wanted, "c").select("c", "k._k1", "k._k2"))
    slots = np.zeros(1 << KEY_BITS, bool)
    taken = one.select(F.shiftrightunsigned("_k1", 64 - KEY_BITS).alias("s")).distinct().toArrow()  # at most 2^23 numbers
    slots[taken.column(0).to_numpy()] = True
    bits = np.packbits(slots)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    # rows that repeat id and text are one before the exchange
    some = map_arrow(keyed.select("_k1", "_k2", "text"), maybe, "_k1 long, _k2 long, text string").dropDuplicates(["_k1", "_k2"])
    return cut(some.join(one, ["_k1", "_k2"]).select("c", "text"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets overlap enough."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    known = pairs.join(degree.select(F.col("c").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("c").alias("b"), F.col("d").alias("db")), "b")
    hub, other = (F.when(F.col("db") > F.col("da"), F.col(x)).otherwise(F.col(y)) for x, y in (("b", "a"), ("a", "b")))
    dealt = known.select(hub.alias("hub"), other.alias("member"), F.ceil(F.greatest("da", "db") / EACH).alias("groups"))
    dealt = cut(dealt.select("hub", "member", F.pmod(F.xxhash64("member"), "groups").alias("salt")))
    members = dealt.join(texts.withColumnRenamed("c", "member"), "member").select("hub", "salt", "member", "text")
    hubs = dealt.select("hub", "salt").distinct().join(texts.withColumnRenamed("c", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("member"), "text")
    rows = members.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return map_arrow(rows.select("hub", "member", "text"), verify(size, percent), "a long, b long")


def _attached(lists: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The lists with an array of what ``values`` (c and ``name``) has for each member, null for none."""
    numbered = lists.withColumn("list", F.struct(F.xxhash64("shingle", "part", "codes"), F.hash("codes", "part", "shingle")))
    flat = numbered.select("list", F.posexplode("codes").alias("i", "c")).join(values, "c", "left")
    by = flat.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("i", name))).alias("x")).select("list", F.col(f"x.{name}").alias(name))
    return numbered.join(by, "list").drop("list")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and its component."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
