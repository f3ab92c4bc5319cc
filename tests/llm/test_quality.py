"""Co-training: pseudo-labels come from all unlabelled documents, and scores hold on rows kept out of the fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality


def passes(monkeypatch, docs, labels):
    """For each pass over the pool: the teachers, and the numbers of rows that the sums hold by view and class."""
    seen = []
    real = quality._pool_sums

    def spied(pool):
        sums = real(pool)

        def run(teachers, students):
            out = sums(teachers, students)
            seen.append((teachers, [[x[0] for x in of_view] for of_view in out], pool))
            return out

        return run

    monkeypatch.setattr(quality, "_pool_sums", spied)
    quality.fit(docs, labels)
    return seen


def test_every_unlabelled_row_takes_part(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    monkeypatch.setattr(quality, "ADDERS", 1)
    seen = passes(monkeypatch, docs, labels)
    known = {r.doc_id for r in labels.where("quality IS NOT NULL").collect()}
    free = [r for r in docs.collect() if r.doc_id not in known]
    a = quality.text_features([(r.text or "").encode() for r in free]).astype(np.float32).astype(float)
    b = quality.meta_features(quality.meta_codes([r.lang for r in free], [r.source for r in free], [r.n_chars for r in free]))
    assert len(seen) == quality.ROUNDS * quality.STEPS
    for teachers, counts, pool in seen[:: quality.STEPS]:
        p = [teachers[0](a), teachers[1](b)]
        assert pool.count() == len(free)
        assert counts == [[(p[1 - v] <= 1 - quality.CONFIDENT).sum(), (p[1 - v] >= quality.CONFIDENT).sum()] for v in (0, 1)]
    assert sum(seen[0][1][0]) > 0


def test_labels_on_the_first_ids_leave_a_pool(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert passes(monkeypatch, docs, labels)[0][2].count() == 100


def test_sums_of_parts_add_up():
    from larkspur.llm._learn import Logistic

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) < 0.4).astype(float)
    model = start = Logistic(x.mean(0), x.std(0), np.zeros(4), 0.0)
    assert start.sums(x, y) == pytest.approx(start.sums(x[:70], y[:70]) + start.sums(x[70:], y[70:]))
    for _ in range(20):
        model = model.stepped(model.sums(x, y), 1e-2)
    assert model(x) == pytest.approx(Logistic.fit(x, y, penalty=1e-2)(x), abs=1e-4)


def test_scores_hold_on_rows_kept_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality IS NOT NULL")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    held = {r.doc_id: r.quality for r in labels.where(out).collect()}
    scores = quality.score(docs, quality.fit(docs, labels.where(~out))).collect()
    good, bad = ([r.score for r in scores if held.get(r.doc_id) == y] for y in (1, 0))
    assert np.mean([s >= quality.KEEP_FROM for s in good]) >= 0.9
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.9
