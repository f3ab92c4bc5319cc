"""Nearest neighbours over randomly rotated one-bit codes.

A vector's residual from a centre is rotated at random and only the signs are
kept, packed to bits, with two scalars: the residual's norm, and the inner
product of the unit residual with its own code.  The inner product with a
query is estimated from the bits and corrected by the second scalar; the
estimate's error is bounded with high probability, so a vector whose lower
distance bound is above the k-th smallest upper bound needs no second look.
The others are reranked by the exact distance of the original vectors.

The centre is the mean of a bounded sample (``SAMPLE`` rows, by hash order);
every row is coded.  Rows and queries meet in a grid of cells (a block of rows
times a block of queries), so no side is ever broadcast whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import partitions_for, table

SAMPLE, SEED, K = 10_000, 20240517, 10
BLOCK_ROWS, BLOCK_QUERIES, EPSILON = 4096, 4096, 4.0


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norms, and inner products of residual and code."""
    rest = vectors.astype(np.float64) - centre
    norm = np.sqrt((rest * rest).sum(1))
    unit = rest / np.where(norm > 0, norm, 1)[:, None] @ turn.T
    return np.packbits(unit > 0, axis=1), norm, np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])


def candidates(codes: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """A matrix of rows by queries: may the row be among the query's k nearest of this block?  own: pairs left out."""
    bits, norm, fit = codes
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    rest = queries.astype(np.float64) - centre
    q_norm = np.sqrt((rest * rest).sum(1))
    unit = rest / np.where(q_norm > 0, q_norm, 1)[:, None] @ turn.T
    fit = np.where(fit > 0, fit, 1)
    inner = (signs @ unit.T.astype(np.float32) / np.sqrt(dim)) / fit[:, None]
    slack = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * EPSILON / np.sqrt(max(dim - 1, 1)) + 1e-5
    base, scale = (norm * norm)[:, None] + (q_norm * q_norm)[None], 2 * norm[:, None] * q_norm[None]
    high = base - scale * np.maximum(inner - slack[:, None], -1)
    low = base - scale * np.minimum(inner + slack[:, None], 1)
    high[own] = np.inf
    low[own] = np.inf
    if len(high) > k:
        worst = np.partition(high, k - 1, axis=0)[k - 1]
        low_enough = low <= worst + 1e-6 * (1 + np.abs(worst))
    else:
        low_enough = np.isfinite(low)
    return low_enough & ~own


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype) for x in column.to_pylist()])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries`` (both vec_id, embedding, ...).

    Nearness is the Euclidean distance in double precision; ties go to the
    smaller vec_id.  Returns query_id, rank, vec_id, score.  Vectors that are
    null, zero, or hold null or non-finite numbers take no part, nor do those
    of a length other than the commonest (the longer on ties) and rows without
    an id.  A row's own rows are those with the query's vec_id; a repeated
    query counts once, a repeated row as often as it stands.  Empty tables give
    no rows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    rows, asked = usable(vectors), usable(queries).dropDuplicates()
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    centre, turn = np.array(sample, np.float64).mean(0), rotation(dim)
    row_blocks, query_blocks = partitions_for(n, BLOCK_ROWS), partitions_for(asked.count(), BLOCK_QUERIES)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(1).to_pylist(), np.float64)
                bits, norm, fit = encode(v, centre, turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(fit)], names=["vec_id", "v", "bits", "norm", "fit"])

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.float64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["vec_id", "v"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, v = left.column("vec_id").to_numpy(), _matrix(left.column("v"), np.float64)
            codes = (_matrix(left.column("bits"), np.uint8), left.column("norm").to_numpy(), left.column("fit").to_numpy())
            q_ids, q = right.column("vec_id").to_numpy(), _matrix(right.column("v"), np.float64)
            for at in range(0, len(q), 256):
                part, part_ids = q[at : at + 256], q_ids[at : at + 256]
                own = ids[:, None] == part_ids[None]
                near = candidates(codes, part, centre, turn, k, own)
                for j in range(len(part)):
                    pick = np.flatnonzero(near[:, j])
                    exact = np.sqrt(np.cumsum((v[pick] - part[j]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
                    for i in np.lexsort((ids[pick], exact))[:k]:
                        out.append((int(part_ids[j]), int(ids[pick[i]]), float(exact[i])))
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    coded = rows.mapInArrow(code, "vec_id long, v binary, bits binary, norm double, fit double")
    coded = coded.withColumn("rb", F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)))
    coded = coded.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sought = asked.mapInArrow(pack, "vec_id long, v binary").withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    sought = sought.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    best = coded.groupBy("rb", "qb").cogroup(sought.groupBy("rb", "qb")).applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


_VECTORS = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
"""

OP10_SQL = f"""
WITH u AS MATERIALIZED ({_VECTORS}),
d AS (
  SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, u.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM u AS q JOIN u ON q.vec_id % 100 = 0 AND u.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
