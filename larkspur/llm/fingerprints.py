"""Document fingerprints by winnowing, with DataFrame functions only.

A text is cut into tokens: runs of at most ``TOKEN`` characters that are not
white space.  Each K consecutive tokens have a rolling (polynomial) hash, built
by doubling: the hash of 2m tokens is that of the first m, moved up, plus that
of the other m.  Of each W consecutive hashes the least is kept, the rightmost
of equals, with the position of its first token.  So two texts that share
K + W - 1 consecutive tokens share a fingerprint there, and a kept position
says where.

Texts: null is the empty text, which has no fingerprints; one of fewer than K
tokens has one fingerprint, of all of them; one of fewer than W hashes has one
window.  A very long text is one row of arrays, about 50 bytes a character
while it is worked on.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import partitions_for, row_key, table

TOKEN, K, W = 8, 4, 8
PRIME, BASE = 2**31 - 1, 1_000_003
PIECE = rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"
_LOW = 2**32 - 1
#: Bytes of text that are put in order in one piece, and most of the bounds that are found for it.
BUCKET_BYTES, BOUNDS = 16_000_000, 1000
#: A table of one small row for each bucket is broadcast up to this many rows.
SMALL = 100_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _with_later(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``step`` places after it."""
    return _let(values, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, i: join(x, F.get(a, i + step))))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprints of a text: an array of (hash long, position int) by position; k and w are powers of two."""
    if k < 1 or w < 1 or k & (k - 1) or w & (w - 1):
        raise ValueError("k and w have to be powers of two")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % PRIME)

    def kept(one: Column) -> Column:
        grams, step = one, 1
        while step < k:
            up = pow(BASE, step, PRIME)
            grams = _with_later(grams, step, lambda a, b, up=up: (a * up + b) % PRIME)
            step *= 2
        whole = F.aggregate(one, F.lit(0).cast("long"), lambda a, b: (a * BASE + b) % PRIME)
        grams = F.when(F.size(one) >= k, grams).when(F.size(one) > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))
        # the position counts down in the low bits, so that of equal hashes the rightmost is least
        return _let(F.transform(grams, lambda g, i: g * (_LOW + 1) + (_LOW - i)), least)

    def least(codes: Column) -> Column:
        windows, step = codes, 1
        while step < w:
            windows = _with_later(windows, step, F.least)
            step *= 2
        short = F.when(F.size(codes) > 0, F.array(F.array_min(codes))).otherwise(codes)
        return F.array_distinct(F.when(F.size(codes) >= w, windows).otherwise(short))

    return F.transform(_let(hashes, kept), lambda c: F.struct(F.shiftright(c, 32).alias("hash"), (F.lit(_LOW) - c.bitwiseAND(F.lit(_LOW))).cast("int").alias("position")))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as text: ``hash:position`` with the hash in 8 hexadecimal digits, by position."""
    return F.array_join(F.transform(fingerprint, lambda f: F.concat(F.lpad(F.hex(f["hash"]), 8, "0"), F.lit(":"), f["position"].cast("string"))), " ")


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda f: f["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two distinct lists; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """One row for each fingerprint of each row of ``docs`` (doc_id, text, ...): doc_id, hash, position.

    Rows that repeat an id or a text have theirs each; an empty table has none.
    """
    return docs.select("doc_id", F.explode(winnow(F.col("text"), k, w)).alias("f")).select("doc_id", "f.hash", "f.position")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and both fingerprints of each row and the next one by descending doc_id; after the last comes the first.

    Rows of one id follow by content, rows without an id come last.  The order
    is made by buckets of ids, within bounds taken from quantiles and evenly
    between two of them; of each bucket only the first row is sent to another
    one as well, so texts cross the network once and no task sees all rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = partitions_for(size, BUCKET_BYTES)
    coarse = min(buckets, BOUNDS)
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / coarse) for i in range(coarse + 1)]), F.lit(10 * BOUNDS))).first()[0] or [0]
    cuts, fine = sorted(set(cuts)), partitions_for(buckets, coarse)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(bounds, at).cast("double"), F.coalesce(F.get(bounds, at), F.lit(cuts[-1])).cast("double")
    share = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
    inside = F.least(F.greatest(share, F.lit(0)), F.lit(fine - 1))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(at.cast("long") * fine + inside))

    first = rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "_k1", "_k2")).alias("first"))
    every = Window.orderBy("bucket")  # one row for each bucket
    to = F.coalesce(F.lead("bucket").over(every), F.min("bucket").over(Window.partitionBy()))
    first = first.select(to.alias("to"), F.bitwise_not("first.down").alias("d"), F.col("first._k1").alias("a"), F.col("first._k2").alias("b"))
    if buckets <= SMALL:
        first = F.broadcast(first)
    edge = rows.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_k1") == F.col("a")) & (F.col("_k2") == F.col("b")))
    edge = edge.dropDuplicates(["to"]).select("doc_id", "text", "_k1", "_k2", F.col("to").alias("bucket"), F.lit(True).alias("edge"))

    order = Window.partitionBy("bucket").orderBy("edge", F.desc_nulls_last("doc_id"), "_k1", "_k2")
    dealt = rows.withColumn("edge", F.lit(False)).unionByName(edge).repartition(buckets, "bucket")
    out = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("own", winnow(F.col("text")))
    out = out.withColumn("next_hashes", F.lead(hashes_of(F.col("own"))).over(order))
    return out.where(~F.col("edge")).select("doc_id", "text", "next_text", "own", "next_hashes")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and of its text with the last third exchanged for the start of the next document."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited_text", edited).withColumn("edited", winnow(F.col("edited_text")))
    own = hashes_of(F.col("own"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(own, hashes_of(F.col("edited"))).alias("near_edited"),
        likeness(own, F.col("next_hashes")).alias("near_next"),
    )


OP11_SQL = rf"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, count(*) OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
pair AS MATERIALIZED (
  SELECT a.r, b.r AS nr, a.doc_id, a.t, length(a.t) AS c,
    substr(a.t, 1, length(a.t) - length(a.t) // 3) || substr(b.t, 1, length(a.t) // 3) AS e
  FROM doc a JOIN doc b ON b.r = a.r % a.n + 1),
side AS (SELECT r, 0 AS s, t FROM pair UNION ALL SELECT r, 1 AS s, e FROM pair),
token AS (
  SELECT r, s, unnest(range(len(w))) AS i, CAST(CAST('0x' || substr(md5(unnest(w)), 1, 8) AS BIGINT) % {PRIME} AS BIGINT) AS h, len(w) AS n
  FROM (SELECT r, s, regexp_extract_all(t, '{PIECE}') AS w FROM side)),
late AS (SELECT *, lead(h, 1) OVER x AS h1, lead(h, 2) OVER x AS h2, lead(h, 3) OVER x AS h3 FROM token WINDOW x AS (PARTITION BY r, s ORDER BY i)),
gram AS MATERIALIZED (
  SELECT r, s, i, n - {K - 1} AS g, (((h * {BASE} + h1) % {PRIME} * {BASE} + h2) % {PRIME} * {BASE} + h3) % {PRIME} AS x FROM late WHERE n >= {K} AND i <= n - {K}
  UNION ALL
  SELECT r, s, 0, 1, CASE n WHEN 1 THEN h WHEN 2 THEN (h * {BASE} + h1) % {PRIME} ELSE ((h * {BASE} + h1) % {PRIME} * {BASE} + h2) % {PRIME} END FROM late WHERE n < {K} AND i = 0),
least_ AS (
  SELECT r, s, i, g, min(x * {_LOW + 1} + ({_LOW} - i)) OVER (PARTITION BY r, s ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS c FROM gram),
kept AS MATERIALIZED (
  SELECT DISTINCT r, s, CAST(c >> 32 AS BIGINT) AS x, {_LOW} - (c & {_LOW}) AS p FROM least_ WHERE i <= greatest(g - {W}, 0)),
print AS (SELECT r, s, string_agg(format('{{:08X}}:{{}}', x, p), ' ' ORDER BY p) AS f, list_distinct(list(x)) AS l FROM kept GROUP BY r, s),
both_ AS (
  SELECT pair.*, coalesce(o.f, '') AS of, coalesce(x.f, '') AS ef, coalesce(o.l, []) AS ol, coalesce(x.l, []) AS el, coalesce(y.l, []) AS nl
  FROM pair LEFT JOIN print o ON o.r = pair.r AND o.s = 0 LEFT JOIN print x ON x.r = pair.r AND x.s = 1 LEFT JOIN print y ON y.r = pair.nr AND y.s = 0)
SELECT doc_id, CAST(c AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, of AS fingerprint, ef AS edited_fingerprint,
  CASE WHEN len(ol) + len(el) = 0 THEN 1.0 ELSE len(list_intersect(ol, el)) / (len(ol) + len(el) - len(list_intersect(ol, el))) END AS near_edited,
  CASE WHEN len(ol) + len(nl) = 0 THEN 1.0 ELSE len(list_intersect(ol, nl)) / (len(ol) + len(nl) - len(list_intersect(ol, nl))) END AS near_next
FROM both_
"""
