"""What executors and their Python workers hold does not follow rows of a partition, only bytes of a batch."""

import sys

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import _spark, decontaminate, ngram_join, packing, quality
from larkspur.llm._text import chunks
from pyspark.sql import functions as F


def packed(spark, docs):
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def scored(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    quality.filter_quality(docs, model).count()
    return quality.score(docs, model)


CASES = {
    packing: packed,
    quality: scored,
    ngram_join: lambda spark, docs: ngram_join.similar(docs),
    decontaminate: lambda spark, docs: decontaminate.contamination(docs, spark.createDataFrame([("a", "some words")], "item_id string, text string")),
}


@pytest.mark.parametrize("module", CASES, ids=lambda m: m.__name__.rpartition(".")[2])
def test_a_partition_comes_in_batches_of_bounded_bytes(spark, monkeypatch, module):
    most = 2 * 4 * 1024 * 1024

    def spied(batches, *args, **kw):
        def seen():
            for batch in batches:
                if batch.nbytes > most:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return chunks(seen(), *args, **kw)

    monkeypatch.setattr(module, "chunks", spied)
    text = F.concat(F.col("doc_id").cast("string"), F.repeat(F.lit(" abcd"), 10_000))  # 15 MB in one partition
    docs = spark.range(0, 300, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", text)
    assert CASES[module](spark, docs).select("doc_id").distinct().count() == 300


def test_a_size_that_the_session_has_set_stays(spark):
    before = spark.conf.get(_spark._BATCH_SETTING)
    try:
        spark.conf.set(_spark._BATCH_SETTING, "1m")
        _spark.bounded_batches(spark)
        assert spark.conf.get(_spark._BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(_spark._BATCH_SETTING, before)


def test_a_worker_gives_back_what_a_task_took(spark):
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        before = resident()
        held = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in pieces that the allocator keeps
        sys.last_piece = held.pop()  # stays, so that the end of the heap can't be cut off
        del held
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([before])], names=["n"])

    def after(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([resident()])], names=["n"])

    one = spark.range(0, 1, 1, 1)
    before = _spark.map_arrow(one, run, "n long").collect()[0][0]
    assert one.mapInArrow(after, "n long").collect()[0][0] < before + 100_000_000
