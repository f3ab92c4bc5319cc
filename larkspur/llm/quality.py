"""Document quality by co-training two views.

One classifier sees the text (shares of characters, repetition, line shapes),
the other the page's metadata (source, language, stated length).  Both start
from the labelled rows.  In each round either labels the unlabelled documents
that it is confident of, and the other is trained on these beside the labelled
rows.  Both are then calibrated on labelled rows kept out of training, and a
logistic model of their calibrated logits scores every document.

The labelled rows of a fit are at most ``TRAIN_ROWS``, by hash order.  Pseudo-
labels are exchanged over all unlabelled documents: each of Newton's steps is
a pass over a table of their features, a hundredth of their texts' size, in
which every partition sums gradients and Hessians.  The pseudo-labelled rows
of a class together weigh ``PSEUDO`` times as much as its labelled ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._learn import Logistic
from larkspur.llm._spark import cut, map_arrow, row_key, table
from larkspur.llm._text import NOT_SPACE, Words, as_bytes, chunks

TRAIN_ROWS, ROUNDS, STEPS, CONFIDENT, PSEUDO, PENALTY = 12_000, 4, 2, 0.95, 0.5, 1e-3
SOURCES, LANGS = 64, 8
#: Sums of more partitions are first added up in so many tasks.
ADDERS = 64
#: A document is kept unless its score is below this.
KEEP_FROM = 0.5

_CLASSES = {
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "bar": [ord("|")],
    "shout": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*@^~<>={}[]\\_+"],
    "mark": [ord(c) for c in ".,;:?'\"()-/"],
    "high": list(range(128, 256)),
}


def text_features(texts: list[bytes | None]) -> np.ndarray:
    """A row of numbers for each text; empty texts have zeros and a flag."""
    words = Words(texts, NOT_SPACE, lower=False)
    n_docs, n = words.n_docs, np.maximum(words.counts, 1)
    bounds = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
    size = np.maximum(np.diff(bounds) - 1, 1)

    def by_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[bounds[1:]] - total[bounds[:-1]]

    columns = [by_text(np.isin(words.data, np.array(codes, np.uint8))) / size for codes in _CLASSES.values()]
    last = words.data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    first = words.data[words.start] if len(words) else last
    of_words = lambda flags: np.bincount(words.doc, flags, n_docs) / n
    length = words.end - words.start
    odd = np.isin(last, np.frombuffer(b"#$%&*!|", np.uint8))
    columns += [of_words(length), of_words(length <= 3), of_words(length >= 12), of_words(odd), of_words((first >= 65) & (first <= 90)), of_words(length == 1)]
    # repetition: distinct words, the commonest one, and words equal to the one before
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    d, s = words.doc[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(s)))
    top = np.zeros(n_docs)
    np.maximum.at(top, d[begin], run)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    columns += [np.bincount(d[new], minlength=n_docs) / n, top / n, of_words(again)]
    lines = by_text(words.data == 10) + 1
    columns += [np.log1p(words.counts / lines), np.log1p(lines), np.log1p(words.counts), words.counts == 0]
    return np.column_stack([np.asarray(c, float) for c in columns])


def meta_codes(lang: list[str | None], source: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """Slots of source and language, log length, and flags of an unknown length and source."""
    slot = lambda x, n: zlib.crc32((x or "").encode()) % n
    rows = [(slot(b, SOURCES), slot(a, LANGS), np.log1p(max(c or 0, 0)), c is None, b is None) for a, b, c in zip(lang, source, n_chars)]
    return np.array(rows, np.float32).reshape(-1, 5)


def meta_features(codes: np.ndarray) -> np.ndarray:
    """Source and language by hashed one-hot columns, and the stated length."""
    out = np.zeros((len(codes), SOURCES + LANGS + 4))
    at = np.arange(len(codes))
    out[at, codes[:, 0].astype(int)] = 1
    out[at, SOURCES + codes[:, 1].astype(int)] = 1
    size = codes[:, 2].astype(float)
    out[:, SOURCES + LANGS :] = np.column_stack([size, size * size, codes[:, 3], codes[:, 4]])
    return out


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def views(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text_scale.logit(self.text.logit(x_text)[:, None]), self.meta_scale.logit(self.meta.logit(x_meta)[:, None])
        return 1 / (1 + np.exp(-a)), 1 / (1 + np.exp(-b)), self.both(np.column_stack([a, b]))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool_sums=None, rounds: int = ROUNDS) -> Model:
    """Fits on labelled rows (every fifth kept for calibration) and an unlabelled pool.

    ``pool_sums(teachers, students)`` gives for each view the sums of its
    student over the pool's rows that the other view's teacher is confident are
    good, and over those that it is confident are bad.
    """
    kept = np.arange(len(y)) % 5 == 4
    models = [Logistic.fit(v[~kept], y[~kept], penalty=PENALTY) for v in views]
    for _ in range(rounds if pool_sums is not None and (~kept).any() else 0):
        teachers = models
        for _ in range(STEPS):
            more, after = pool_sums(teachers, models), []
            for v in (0, 1):
                total = models[v].sums(views[v][~kept], y[~kept])
                for label in (1, 0):
                    mine = more[v][label]
                    total = total + mine * (PSEUDO * (y[~kept] == label).sum() / max(mine[0], 1.0))
                after.append(models[v].stepped(total, PENALTY))
            models = after
    held = [models[v].logit(views[v][kept])[:, None] for v in (0, 1)]
    scales = [Logistic.fit(np.vstack([x, [[-3.0]], [[3.0]]]), np.append(y[kept], [0, 1])) for x in held]
    both = np.column_stack([s.logit(x) for s, x in zip(scales, held)])
    return Model(models[0], models[1], scales[0], scales[1], Logistic.fit(np.vstack([both, [-3.0, -3.0], [3.0, 3.0]]), np.append(y[kept], [0, 1])))


_META = ["lang", "source", "n_chars"]


def _with_meta(docs: DataFrame) -> DataFrame:
    """The columns that the views read; absent ones are null."""
    have = {f.name: f.dataType for f in docs.schema.fields}
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return docs.select("doc_id", "text", *[(F.col(c).cast(kinds[c]) if c in have else F.lit(None).cast(kinds[c])).alias(c) for c in _META])


def _measured(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return text_features(as_bytes(batch.column(at))), meta_features(meta_codes(*(batch.column(at + 1 + i).to_pylist() for i in range(3))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and metadata -> doc_id and both views as bytes of 32-bit numbers."""
    for batch in chunks(batches):
        a, b = text_features(as_bytes(batch.column(1))).astype(np.float32), meta_codes(*(batch.column(2 + i).to_pylist() for i in range(3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (a, b))], names=["doc_id", "a", "b"])


def _views(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1) for x in (a, b))
    return a.astype(float), meta_features(b)


def _pool_sums(pool: DataFrame):
    """The sums of ``co_train`` over a table of packed views."""
    many = pool.rdd.getNumPartitions() > ADDERS

    def sums(teachers: list[Logistic], students: list[Logistic]):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _views(batch.column(0), batch.column(1))
                p = [t(x[v]) for v, t in enumerate(teachers)]
                parts = []
                for v in (0, 1):
                    for sure, label in ((p[1 - v] <= 1 - CONFIDENT, 0.0), (p[1 - v] >= CONFIDENT, 1.0)):
                        parts.append(students[v].sums(x[v][sure], np.full(sure.sum(), label)))
                total = np.concatenate(parts) + (0 if total is None else total)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(x, float) for batch in batches for x in batch.column(0).to_pylist())
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        rows = map_arrow(pool, of, "sums binary")
        if many:
            rows = map_arrow(rows.repartition(ADDERS), added, "sums binary")
        sizes = [2 + len(s.weights) + (1 + len(s.weights)) ** 2 for s in students]
        total = sum((np.frombuffer(x, float) for x in rows.toArrow().column(0).to_pylist()), np.zeros(2 * sum(sizes)))
        cuts = np.split(total, np.cumsum([sizes[0], sizes[0], sizes[1]]))
        return (cuts[0], cuts[1]), (cuts[2], cuts[3])

    return sums


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``train_rows`` rows of ``docs`` with a label, by hash order, and from all without one.

    Of labels (doc_id, quality, ...) null ids and null labels are passed over,
    and of several labels the least counts.  Columns lang, source and n_chars
    that ``docs`` lacks count as null.  Without any labelled row the model
    keeps everything.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = cut(map_arrow(_with_meta(docs), _packed, f"doc_id {id_type}, a binary, b binary"))
    train = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = packed.join(F.broadcast(train), "doc_id").select("quality", "a", "b", F.xxhash64("doc_id", "a", "b").alias("h"))  # at most train_rows ids
    got = sample.orderBy("h", "quality").limit(train_rows).toArrow()
    if not got.num_rows:  # nothing to learn from: keep everything
        return co_train((text_features([b""]), meta_features(meta_codes([None], [None], [None]))), np.array([1.0]))
    pool = cut(packed.join(known, "doc_id", "left_anti").select("a", "b"))
    return co_train(_views(got.column("a"), got.column("b")), got.column("quality").to_numpy().astype(float), _pool_sums(pool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, _k1, _k2, text_score, meta_score and score (1: good) of every row of ``docs``.

    Reads doc_id, text, lang, source, n_chars; other columns are ignored and
    missing or null ones count as unknown.  Null and empty texts are scored as
    empty.  Rows with null or repeated ids are scored like all others.
    """
    rows = _with_meta(docs).select("doc_id", *row_key("doc_id", "text"), "text", *_META)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            scores = model.views(*_measured(batch, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, scores)], names=["doc_id", "_k1", "_k2", "text_score", "meta_score", "score"])

    return map_arrow(rows, run, f"doc_id {id_type}, _k1 long, _k2 long, text_score double, meta_score double, score double")


def filter_quality(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose score is at least ``keep_from``; columns as in ``score``."""
    columns = {name: i for i, name in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at=columns["text"]):
            meta = [batch.column(columns[c]).to_pylist() if c in columns else [None] * batch.num_rows for c in _META]
            x = text_features(as_bytes(batch.column(columns["text"]))), meta_features(meta_codes(*meta))
            yield batch.filter(pa.array(model.views(*x)[2] >= keep_from))

    return map_arrow(docs, run, docs.schema)


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views and together."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= KEEP_FROM).alias("keep"))
