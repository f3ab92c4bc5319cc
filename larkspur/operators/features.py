"""Numeric features of source files, for the file score.

What needs the syntax tree is counted in the pass that finds the facts; what
follows from findings is a Catalyst expression over the same row.  A file's
features are one map, so nothing is shuffled.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.operators import rules as R
from larkspur.functions.patterns import marked
from larkspur.operators.analysis import _BUILTINS, Walk, guarded, is_setup_name
from larkspur.operators.dealing import dealt
from larkspur.operators.limits import SECONDS, Limited
from larkspur.operators.order import with_sequence
from larkspur.operators.relations import related
from larkspur.operators.repeated import Repeated

_LEVEL_KEYS = {1: "verylow", 2: "low", 3: "medium", 4: "high", 5: "veryhigh"}
_STATEMENTS = {"AsyncFunctionDef": "FunctionDef", "AsyncFor": "For", "AsyncWith": "With", "TryStar": "Try"}
_EXPRESSIONS = {"NamedExpr": "Named", "IfExp": "If", "JoinedStr": "FString", "GeneratorExp": "Generator"}
_TAINT_KEYS = {"Literal": "literal", "Decoded": "decoded", "Deobfuscated": "deobfuscated", "FileSourced": "file_sourced", "NetworkSourced": "network_sourced", "Fingerprinting": "fingerprinting", "EnvVariables": "env_variables"}
_TRANSFORMS = ["Base64", "Hex", "Concat", "Join", "Subscript", "FString", "Other"]
_VARS = {f"{p}{n}" for p in ("", "builtins.", "__builtins__.") for n in ("globals", "locals", "vars")}
_URLLIB, _DLL = re.compile(C.EXFIL_URLLIB), re.compile(C.DLL_CALLS)
#: Feature of a call by its qualified name.
_CALLS = [
    ("shell_exec", set(C.SHELL_COMMANDS).__contains__),
    ("code_exec", set(C.CODE_EXEC).__contains__),
    ("exfiltration_sink", lambda n: n in _SINKS or bool(_URLLIB.match(n))),
    ("download_request", set(C.DOWNLOADS).__contains__),
    ("env_access", set(C.ENV_CALLS).__contains__),
    ("suspicious_builtin", lambda n: n.rsplit(".", 1)[-1] in C.SUSPICIOUS_BUILTINS and n.rsplit(".", 1)[0] in (n, "builtins", "__builtins__")),
    ("import_call", set(C.IMPORT_CALLS).__contains__),
    ("indirect_exec", set(C.INDIRECT_EXEC).__contains__),
    ("os_fingerprint", set(C.FINGERPRINTS).__contains__),
    ("clipboard_read", set(C.CLIPBOARD).__contains__),
    ("screenshot_capture", set(C.SCREENSHOTS).__contains__),
    ("dll_injection", lambda n: bool(_DLL.match(n))),
    ("pathlib_write", set(C.PATH_WRITES).__contains__),
    ("module_registry", set(C.REGISTRIES).__contains__),
    ("io_resource_ctor", set(C.CONSTRUCTORS).__contains__),
    ("vars_function", _VARS.__contains__),
]
_SINKS = set(C.EXFIL_SINKS)
_DYNAMIC = {f"{p}{n}" for p in ("", "builtins.", "__builtins__.") for n in ("exec", "compile", "eval")} | set(C.GETATTR) | set(C.IMPORT_CALLS)


def entropy(text: str) -> float:
    """Shannon entropy of the characters, in bits, summed in the characters' order."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for _, k in sorted(Counter(text).items())) if n else 0.0


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a last empty one does not count."""
    out = text.split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def source_features(text: str) -> dict[str, float]:
    """Lines, bytes and characters of a text."""
    lines = lines_of(text)
    each = [entropy(x) for x in lines]
    return {
        "source.num_lines": len(lines),
        "source.num_nonempty_lines": sum(bool(x.strip()) for x in lines),
        "source.num_comment_lines": sum(x.lstrip().startswith("#") for x in lines),
        "source.num_bytes": len(text.encode("utf-8", "replace")),
        "source.longest_line": max(map(len, lines), default=0),
        "source.avg_line_length": _mean(list(map(len, lines))),
        "source.non_ascii_ratio": sum(ord(c) > 127 for c in text) / len(text) if text else 0.0,
        "source.max_line_entropy": max(each, default=0.0),
        "source.mean_line_entropy": _mean(each),
    }


class _Syntax:
    """Counts over a syntax tree."""

    def __init__(self, tree: ast.Module | None, text: str):
        self.n: Counter[str] = Counter()
        self.strings: list[str] = []
        self.names: set[str] = set()
        self.deepest, self.branches, self.text = 0, 1, text.split("\n")
        if tree is not None:
            self.walk(tree)

    def walk(self, root: ast.AST) -> None:
        todo: list[tuple[ast.AST, int, bool]] = [(root, 0, False)]
        while todo:
            node, depth, in_format = todo.pop()
            self.deepest = max(self.deepest, depth)
            inside = isinstance(node, (ast.JoinedStr, ast.FormattedValue))
            if isinstance(node, ast.stmt):
                self.statement(node)
            elif isinstance(node, ast.expr) and not (in_format and isinstance(node, (ast.Constant, ast.FormattedValue)) or in_format and isinstance(node, ast.JoinedStr)):
                self.expression(node)
            for name, value in ast.iter_fields(node):
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST) and not isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                        plain = isinstance(node, ast.FormattedValue) and name == "value"
                        todo.append((child, depth + 1, inside and not plain))

    def statement(self, s: ast.stmt) -> None:
        kind = type(s).__name__
        elif_ = isinstance(s, ast.If) and self.text[s.lineno - 1].encode("utf-8", "replace")[s.col_offset : s.col_offset + 4] == b"elif"
        if not elif_:
            self.n[f"stmt.{_STATEMENTS.get(kind, kind)}"] += 1
        self.n["functions"] += kind in ("FunctionDef", "AsyncFunctionDef")
        self.n["async"] += kind == "AsyncFunctionDef"
        self.n["classes"] += kind == "ClassDef"
        self.n["imports"] += kind == "Import"
        self.n["import_froms"] += kind == "ImportFrom"
        self.branches += kind in ("If", "While", "For", "AsyncFor")
        if isinstance(s, (ast.Try, ast.TryStar)):
            self.branches += len(s.handlers)
        if isinstance(s, ast.Match):
            self.branches += len(s.cases) + sum(c.guard is not None for c in s.cases)

    def expression(self, e: ast.expr) -> None:
        kind = type(e).__name__
        if isinstance(e, ast.Constant):
            v = e.value
            kind = "StringLiteral" if isinstance(v, str) else "BytesLiteral" if isinstance(v, bytes) else "BooleanLiteral" if isinstance(v, bool) else "NoneLiteral" if v is None else "EllipsisLiteral" if v is ... else "NumberLiteral"
            if isinstance(v, str):
                self.strings.append(v)
        self.n[f"expr.{_EXPRESSIONS.get(kind, kind)}"] += 1
        self.n["exprs"] += 1
        if isinstance(e, ast.BinOp):
            self.n[f"expr.op.{type(e.op).__name__}"] += 1
        if isinstance(e, ast.Name):
            self.names.add(e.id)
        self.n["calls"] += isinstance(e, ast.Call)
        self.branches += isinstance(e, ast.IfExp)
        if isinstance(e, ast.BoolOp):
            self.branches += len(e.values) - 1

    def features(self, source: str) -> dict[str, float]:
        n, strings, names = self.n, self.strings, sorted(self.names)
        lengths, each = [len(s) for s in strings], [entropy(s) for s in strings]
        base64 = [bool(re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", s)) and len(s) % 4 == 0 and s != "" for s in strings]
        hexed = [bool(re.fullmatch(r"(\\x[0-9a-fA-F]{2})+", s)) for s in strings]
        out = {
            "source.string_ratio": sum(lengths) / len(source) if source else 0.0,
            "ast.max_depth": self.deepest,
            "ast.num_functions": n["functions"],
            "ast.num_async_functions": n["async"],
            "ast.num_classes": n["classes"],
            "ast.num_calls": n["calls"],
            "ast.num_imports": n["imports"],
            "ast.num_import_froms": n["import_froms"],
            "ast.cyclomatic_complexity": self.branches,
            "ast.cyclomatic_complexity_per_fn": self.branches / max(n["functions"], 1),
            "ast.total_exprs": n["exprs"],
            "literal.num_strings": len(strings),
            "literal.max_string_length": max(lengths, default=0),
            "literal.mean_string_length": _mean(lengths),
            "literal.max_string_entropy": max(each, default=0.0),
            "literal.mean_string_entropy": _mean(each),
            "literal.base64_candidate_count": sum(ok and len(s) >= C.BASE64_LEAST for ok, s in zip(base64, strings)),
            "literal.base64_long_count": sum(ok and len(s) >= C.BASE64_LONG for ok, s in zip(base64, strings)),
            "literal.hex_escape_count": sum(hexed),
            "literal.long_hex_string_count": sum(ok and len(s) >= C.HEX_LONG for ok, s in zip(hexed, strings)),
            "literal.url_count": sum("http://" in s or "https://" in s for s in strings),
            "literal.ip_address_count": sum(is_ipv4(s) for s in strings),
            "literal.suspicious_ext_count": sum(s.lower().endswith(tuple(C.LITERAL_EXTENSIONS)) for s in strings),
            "ident.name_count": len(names),
            "ident.max_name_length": max(map(len, names), default=0),
            "ident.mean_name_length": _mean(list(map(len, names))),
            "ident.max_name_entropy": max(map(entropy, names), default=0.0),
            "ident.mean_name_entropy": _mean(list(map(entropy, names))),
            "ident.short_name_ratio": _mean([float(len(x) <= 2) for x in names]),
        }
        out |= {k: v for k, v in n.items() if "." in k}
        if any(f in s for f in C.VERSION_FILES for s in strings):
            out["contain_version_file"] = 1
        return out


def is_ipv4(text: str) -> bool:
    """Four groups of one to three digits up to 255, with any leading zeros."""
    parts = text.split(".")
    return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) < 256 for p in parts)


class FeatureWalk(Walk):
    """A walk that also keeps the taints of each expression and the imports of the module."""

    def __init__(self, source: str, is_setup: bool = False):
        super().__init__(source, is_setup)
        self.values: dict[int, tuple[ast.expr, frozenset, frozenset]] = {}
        self.imported: dict[str, str] = {}

    def value(self, e):
        v = super().value(e)
        if e is not None and not self.inline_depth and (v.taints or v.params):
            self.values[id(e)] = (e, v.taints, v.params)
        return v

    def statement(self, s) -> None:
        super().statement(s)
        if len(self.scopes) == 1 and isinstance(s, (ast.Import, ast.ImportFrom)):
            for a in s.names:
                name = a.asname or (a.name.split(".")[0] if isinstance(s, ast.Import) else a.name)
                if name in self.scopes[0]:
                    self.imported[name] = self.scopes[0][name].path

    def features(self) -> dict[str, float]:
        """Imports, taints, transformations and calls; what was found in nested texts does not count."""
        out: dict[str, float] = {}
        roots = {p.lstrip(".").split(".")[0] for name, p in self.imported.items() if p and self.scopes[0].get(name) is not None and self.scopes[0][name].path == p} - {""}
        own = [f for f in self.facts if f["depth"] == self.depth]
        calls = [f["name"] for f in own if f["kind"] == "call" and f["name"]]
        out["import.suspicious_pair_count"] = sum(roots.issuperset(p) for p in C.IMPORT_PAIRS)
        out["import.suspicious_triple_count"] = sum(roots.issuperset(t) for t in C.IMPORT_TRIPLES)
        out["import.unique_roots"] = len(roots)
        out |= {f"import.module.{r}": 1 for r in roots}
        out |= {f"builtin.global.{b}": 1 for b in _BUILTINS - self.scopes[0].keys()}
        out |= {f"builtin.import.{c.rsplit('.', 1)[-1]}": 1 for c in calls if c.split(".")[0] in ("builtins", "__builtins__")}
        kinds = [(len(t) + len(p), t, p) for _, t, p in self.values.values()]
        out["semantic.tainted_nodes"] = len(kinds)
        out["semantic.multi_taint_nodes"] = sum(n >= 2 for n, _, _ in kinds)
        out["semantic.taint_richness"] = _mean([n for n, _, _ in kinds])
        for key, n in Counter(t for _, ts, _ in kinds for t in ts).items():
            out[f"taint.{_TAINT_KEYS[key]}"] = n
        hows = Counter(f["how"] for f in own if f["kind"] in ("literal", "part") and f["how"] in _TRANSFORMS)
        out["semantic.decoded_nodes"] = sum(hows.values())
        out["semantic.encoding_diversity"] = len(hows)
        out |= {f"transform.{k.lower()}": n for k, n in hows.items()}
        out["semantic.qualified_calls"] = len(calls)
        for key, test in _CALLS:
            if n := sum(map(test, calls)):
                out[f"call.{key}"] = n
        if n := sum(c in _DYNAMIC for c in calls):
            out["call.dynamic_count"] = n
        for name, n in Counter(c for c in calls if c.split(".")[0] in C.STDLIB).items():
            out[f"call.{name}"] = n
        return out


def facts_and_counts(source: str | None, path: str | None) -> tuple[list[dict], dict[str, float]]:
    """A source's facts, and the features that need its tree; nothing for a null source."""
    if source is None:
        return [], {}
    walk = FeatureWalk(source, is_setup_name(path))
    found = guarded(walk)
    out = source_features(source) | _Syntax(walk.tree, walk.source).features(source) | walk.features()
    out["semantic.decoded_ratio"] = out["semantic.decoded_nodes"] / out["ast.total_exprs"] if out["ast.total_exprs"] else 0.0
    out["call.dynamic_ratio"] = out.get("call.dynamic_count", 0) / out["ast.num_calls"] if out["ast.num_calls"] else 0.0
    return found, {k: float(v) for k, v in out.items()}


def with_counts(sources: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """``sources`` (file_id, file_path, content, ...) with ``facts`` and the map ``counts``; limits as in ``rules.with_facts``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields)
    path_at, content_at = sources.columns.index("file_path"), sources.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def call(text: str, path: str | None):
            found, counts = facts_and_counts(text, path)
            return marked(found), counts

        def made(answers: list) -> tuple[pa.Array, pa.Array]:
            whole = [(a, {}) if isinstance(a, Exception) else a for a in answers]  # no counts where the limits were reached
            return R.facts_array([found for found, _ in whole]), pa.array([list(counts.items()) for _, counts in whole], pa.map_(pa.string(), pa.float64()))

        with Limited(call, seconds) as limited:
            yield from Repeated(limited, made, ([], {})).batches(batches, content_at, path_at, ["facts", "counts"])

    return dealt(sources).mapInArrow(run, f"{schema}, facts array<{R.FACT}>, counts map<string,double>").withColumn("facts", related(F.col("facts")))


def _when(level: int):
    """A function of one column that is null for other levels."""
    return lambda x: F.when(x == level, x)


def rule_features(findings: Column) -> Column:
    """Hits and confidences of a file's findings, in all and for each rule, as entries of a map."""
    levels = F.transform(findings, lambda x: x["confidence"].cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    entry = lambda name, value: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("key"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    whole = F.array(entry("rule.total_hits", F.size(findings)), entry("rule.score_sum", total(levels)), entry("rule.score_max", F.array_max(levels)), entry("rule.score_min", F.array_min(levels)))

    def of(code: Column) -> Column:
        mine = F.transform(F.filter(findings, lambda x: x["rule"] == code), lambda x: x["confidence"].cast("double"))
        each = [("count", F.size), ("conf_sum", total), ("conf_max", F.array_max), ("conf_min", F.array_min)]
        return F.array(*[entry(F.concat(F.lit(f"rule.{name}."), code), f(mine)) for name, f in each])

    codes = F.array(*[F.lit(code) for code, *_ in C.RULES])
    seen = F.filter(
        F.array(*[F.struct(F.lit(f"confidence.{name}").alias("key"), F.size(F.array_compact(F.transform(levels, _when(n)))).cast("double").alias("value")) for n, name in _LEVEL_KEYS.items()]),
        lambda x: x["value"] > 0,
    )
    return F.concat(whole, F.flatten(F.transform(codes, of)), seen)


def features(sources: DataFrame) -> DataFrame:
    """``sources`` with ``findings`` and ``features``, a map in the order of its keys; a null source has the features of no finding."""
    found = R.with_findings(with_counts(sources))
    every = F.array_sort(F.concat(F.map_entries("counts"), rule_features(F.col("findings"))))
    counted = F.concat(every, F.array(F.struct(F.lit("meta.feature_count").alias("key"), F.size(every).cast("double").alias("value"))))
    return found.withColumn("features", F.map_from_entries(F.array_sort(counted))).drop("counts", "facts")


def numbered_names(featured: DataFrame, seen: Column) -> DataFrame:
    """The distinct names in the maps ``features``, numbered from 0 by the least ``seen`` of a row that has them, then by name: name, number.

    Names are counted where they are and numbered by ranges; none is on the driver.
    """
    first = featured.select(seen.alias("seen"), F.explode(F.map_keys("features")).alias("name")).groupBy("name").agg(F.min("seen").alias("seen"))
    return with_sequence(first, [F.col("seen"), F.col("name")], "number").select("name", "number")


def vocabulary(featured: DataFrame, order: str = "file_id") -> DataFrame:
    """The distinct names, numbered by their first row in the order of a column: name, index."""
    return numbered_names(featured, F.col(order)).select("name", F.col("number").cast("int").alias("index"))


def dense(featured: DataFrame, names: list[str]) -> DataFrame:
    """The features as an array in the order of ``names``, 0 where absent."""
    wanted = F.array(*map(F.lit, names))
    return featured.withColumn("vector", F.transform(wanted, lambda n: F.coalesce(F.element_at("features", n), F.lit(0.0))))
