"""DuckDB SQL for the contracts of op4, op7 and op8, by brute force over all windows."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"


def _words(table: str, pattern: str, key: str, lower: bool) -> str:
    text = _LOWER.format("coalesce(text, '')") if lower else "coalesce(text, '')"
    return f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table}"


OP4_SQL = f"""
WITH doc AS MATERIALIZED ({_words("documents", _ALNUM, "doc_id", True)}),
item AS MATERIALIZED ({_words("benchmark", _ALNUM, "item_id", True)}),
windows AS MATERIALIZED (
  SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS t FROM item WHERE len(w) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, 10 AS k, array_to_string(w[i:i + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item WHERE len(w) >= 10)),
lengths AS (SELECT DISTINCT k FROM windows),
place AS MATERIALIZED (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, lengths WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT DISTINCT p.r, p.i, p.k, x.item_id FROM place p JOIN windows x ON x.t = p.t AND x.k = p.k),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (r) LEFT JOIN items s USING (r)
"""

OP7_SQL = f"""
WITH RECURSIVE doc AS MATERIALIZED ({_words("documents", _PLAIN, "doc_id", True)}),
shingle AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM shingle GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
least AS (SELECT reach.a AS r, min(d.doc_id) AS least FROM reach JOIN doc d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.least AS component_id
FROM doc d JOIN least l USING (r) LEFT JOIN size s USING (r)
"""

OP8_SQL = f"""
WITH doc AS MATERIALIZED ({_words("documents", _PLAIN, "doc_id", False)}),
place AS MATERIALIZED (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
twice AS (SELECT t FROM place GROUP BY t HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM place JOIN twice USING (t)),
word AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM doc),
kept AS (SELECT word.r, count(*) AS n, string_agg(x, ' ' ORDER BY word.j) AS t FROM word ANTI JOIN gone ON gone.r = word.r AND gone.j = word.j GROUP BY word.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (r)
"""
