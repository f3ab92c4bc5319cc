"""The corpus pipeline: quality, near duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of ``documents``, whatever they are called;
columns added on the way have names that no column has.  Every stage takes
null and repeated ids, null, empty and very long texts and repeated rows, and
gives no rows for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, ngram_join, packing, pii, quality
from larkspur.llm._spark import free_names, row_key, shared_folder, table

#: Any character that is part of a word of the n-gram join.
_HAS_WORD = r"[^\x20\x09-\x0D]"
#: The secret of the surrogates; where the session sets none, that of the registered query.
KEY_SETTING = "larkspur.pii.key"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; rows that repeat an id and text are judged alike."""
    return quality.filter_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = free_names(docs, "_k1", "_k2")
    return docs.withColumns(dict(zip(names, row_key("doc_id", "text")))), names


def _keep_rows(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose content key (_k1, _k2) stands in ``decided``; with ``once`` one row of each key."""
    keyed, names = _keyed(docs)
    if once:  # a sum by key before the exchange, so a row repeated very often is no bottleneck
        keyed = keyed.dropDuplicates(names)
    wanted = decided.select(F.col("_k1").alias(names[0]), F.col("_k2").alias(names[1])).distinct()
    return keyed.join(wanted, names, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least id, nulls last, then of least content key.

    Rows that repeat id and text are one text, of which one row stays.  Texts
    without words are in no group and stay, each row of them.
    """
    found = ngram_join.similar(docs).where("n_shingles > 0")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2")).alias("x"))
    worded = F.coalesce(F.col("text").rlike(_HAS_WORD), F.lit(False))
    return _keep_rows(docs.where(worded), first.select("x._k1", "x._k2"), once=True).unionByName(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; repeated rows stay as often as they stand."""
    return _keep_rows(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("size(spans) = 0"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the text where it is a column."""
    out = pii.pseudonymise(docs, spark.conf.get(KEY_SETTING, pii.QUERY_KEY))
    count = out.columns[-1]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids; a null or empty text is its end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: the first stage is a trained model and the last a tokenizer.  ``tests/llm/test_pipeline.py`` holds the stages
#: against brute force, each on what the one before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
