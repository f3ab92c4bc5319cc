"""Detection rules as one expression over a row of facts: no join, no shuffle, one scan.

Every rule is a Catalyst expression that gives a finding or null; a fact's
findings are the rules that fire.  The dimension tables behind the rules are
fixed values of a few hundred entries, held as literals.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.functions import text as T
from larkspur.functions.patterns import SPAN, marked
from larkspur.operators.analysis import EXTRA, HARD_SUBJECT, LEAST_HIGH, PYTHON, SUSPICIOUS, is_setup_name  # noqa: F401  is_setup_name is part of this module's surface
from larkspur.operators.dealing import dealt
from larkspur.operators.limits import SECONDS, CallFailed, Limited, LimitReached
from larkspur.operators.relations import related
from larkspur.operators.repeated import Repeated

FACT = "struct<kind:string,ord:int,start:int,end:int,name:string,text:string,how:string,taints:array<string>,number:int,depth:int>"
FINDING = "struct<rule:string,confidence:int,label:string,description:string>"
CODE = {name: code for code, name, *_ in C.RULES}
VERY_LOW, LOW, MEDIUM, HIGH, VERY_HIGH = 1, 2, 3, 4, 5
_PLACE = ("ord", "depth", "start", "end")
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("how", pa.string()), ("taints", pa.list_(pa.string())), ("number", pa.int32()), ("depth", pa.int32())])
)


def within(limited: Limited, text: str | None, path: str | None, empty=list):
    """What a limited call finds in a text; one that reaches its limits or fails has an ``error`` fact."""
    if text is None:
        return empty()
    try:
        return limited.run(text, path)
    except (LimitReached, CallFailed) as error:
        return error_facts(error)


def error_facts(error: Exception) -> list[dict]:
    return [{"kind": "error", "ord": 0, "start": 0, "end": 0, "name": str(error)[:200], "text": None, "how": "", "taints": [], "number": 0, "depth": 0}]


def facts_array(answers: list[list[dict] | Exception]) -> pa.Array:
    """The facts of files, one row each."""
    return pa.array([error_facts(a) if isinstance(a, Exception) else a for a in answers], _ARROW)


def with_facts(sources: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """``sources`` (file_id, file_path, content, ...) with a column ``facts``; text of facts is kept whole.

    Files are dealt to all cores, since a few bytes of them are much work.  A
    file is analysed in a child process of the worker; one that takes longer
    than ``seconds`` or too much memory has an ``error`` fact, and the job goes on.
    Files of one text are analysed once, as long as the task remembers it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields)
    path_at, content_at = sources.columns.index("file_path"), sources.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from larkspur.operators.analysis import facts

        with Limited(lambda text, path: marked(facts(text, path)), seconds) as limited:
            yield from Repeated(limited, lambda answers: (facts_array(answers),), []).batches(batches, content_at, path_at, ["facts"])

    return dealt(sources).mapInArrow(run, f"{schema}, facts array<{FACT}>").withColumn("facts", related(F.col("facts")))


@dataclass(frozen=True)
class Rule:
    """A rule of one's own: ``finds`` takes the fields of a fact by name and gives when it fires, how sure it is (1 to 5) and its label."""

    code: str
    description: str
    finds: Callable[[Mapping[str, Column]], tuple[Column, Column | int, Column]]

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z][\w-]*", self.code) or self.code in CODE.values():
            raise ValueError(f"a rule needs a code of its own: {self.code!r}")

    def finding(self, fact: Mapping[str, Column]) -> Column:
        when, confidence, label = self.finds(fact)
        level = F.lit(confidence) if isinstance(confidence, int) else confidence
        return F.when(when, F.struct(F.lit(self.code).alias("rule"), F.greatest(F.lit(VERY_LOW), F.least(level, F.lit(VERY_HIGH))).cast("int").alias("confidence"), label.cast("string").alias("label"), F.lit(self.description).alias("description")))


def _finding(when: Column, rule: str, confidence: Column | int, label: Column, description: Column | str | None = None) -> Column:
    text = next(d for _, n, d, _ in C.RULES if n == rule)
    confidence = F.lit(confidence) if isinstance(confidence, int) else confidence
    description = F.lit(description or text) if not isinstance(description, Column) else F.coalesce(description, F.lit(text))
    return F.when(when, F.struct(F.lit(CODE[rule]).alias("rule"), confidence.cast("int").alias("confidence"), label.alias("label"), description.alias("description")))


def _table(rows: list[dict], schema: str) -> Column:
    """Fixed rows as one constant, an array of structs: a single expression, however many rows there are."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(f.replace(' ', ':') for f in schema.split(', '))}>>")


def _worst(taints: Column) -> Column:
    """Confidence of data with these taints leaving the machine."""
    return F.when(F.arrays_overlap(taints, F.array(*map(F.lit, ("Decoded", "Deobfuscated", "Fingerprinting")))), HIGH).otherwise(MEDIUM)


_FIELDS = ("kind", "name", "text", "how", "taints", "number", "depth")


def _first_named(name: Column, entries: Sequence[tuple[str, int]], rule: str) -> Column:
    """The finding of the first entry (part of a name, confidence), in the catalogue's order, that a name holds."""
    low = F.lower(name)
    return F.coalesce(*[_finding(F.contains(low, F.lit(part)), rule, confidence, name) for part, confidence in entries])


def _first_module(name: Column) -> Column:
    """The finding of the first entry of the catalogue for a module."""
    rule_of = {code: rule for rule, code in CODE.items()}
    first = {}
    for module, _, confidence, code in C.IMPORTS:
        first.setdefault(module, (rule_of[code], confidence))
    return F.coalesce(*[_finding(name == module, rule, confidence, name) for module, (rule, confidence) in first.items()])


def _by_kind(f: Column | Mapping[str, Column]) -> dict[str, list[Column]]:
    """The catalogue's rules by the kind of fact that they look at, the commonest kinds first."""
    name, text, how, taints, number = (f[x] for x in ("name", "text", "how", "taints", "number"))
    among = lambda names: name.isin(list(names))
    called = [_first_named(name, C.IDENTIFIERS, "SuspiciousFunctionName")]
    return {
        "literal": _literal_rules(text, how, number),
        "target": [_first_named(name, C.IDENTIFIERS, "SuspiciousVariable")],
        "call": [
            _finding(among(C.FINGERPRINTS), "OSFingerprint", MEDIUM, name),
            _finding(among(C.CLIPBOARD), "ClipboardRead", LOW, name),
            _finding(among(C.SCREENSHOTS), "ScreenshotCapture", MEDIUM, name),
            _finding(name.rlike(C.DLL_CALLS), "DLLInjection", HIGH, name),
            _finding(name == "os.dup2", "SuspiciousCall", F.when((number > 0) | F.array_contains(taints, "NetworkSourced"), HIGH).otherwise(MEDIUM), name),
            _finding(name == "pty.spawn", "SuspiciousCall", HIGH, name),
        ],
        "called": called,
        "import": [_first_module(name)],
        "exec": _exec_rules(name, text, how, taints, number),
        "def": called,
        "param": [_first_named(name, C.IDENTIFIERS, "SuspiciousParameterName")],
        "comment": [_finding(F.contains(F.lower(text), F.lit(marker.lower())), "SuspiciousComment", VERY_HIGH, F.lit(marker), description) for marker, description in C.COMMENTS],
        "env": [_finding(among(C.ENV_VARS), "EnvAccess", MEDIUM, name)],
        "environment": [_finding(F.lit(True), "OSFingerprint", HIGH, name)],
        "dynamic_import": [_finding(~among(C.IGNORED_DYNAMIC_IMPORTS), "DunderImport", MEDIUM, F.concat(F.lit('__import__("'), name, F.lit('")')))],
        "builtins": [_finding(F.lit(True), "BuiltinsVariable", HIGH, name)],
        "numbers": [_finding(how == "Hex", "HexedLiterals", MEDIUM, name), _finding(how == "Int", "IntLiterals", MEDIUM, name)],
        "exfil": [_finding(F.lit(True), "DataExfiltration", _worst(taints), name)],
        "cmdclass": [_finding(F.lit(True), "InstallHook", HIGH, F.concat(F.lit("cmdclass:"), name))],
        "hook": [_finding(F.lit(True), "InstallHook", F.when(number > 1, VERY_HIGH).otherwise(MEDIUM), name)],
        "write": [_finding(T.ends_with_any(name, C.WRITE_EXTENSIONS), "SuspiciousWrite", HIGH, name)],
        "download": [
            _finding(
                T.ends_with_any(T.bare_url(name), C.DOWNLOAD_EXTENSIONS) | T.ends_with_any(T.bare_url(text), C.DOWNLOAD_EXTENSIONS) | (number > 0),
                "BinaryDownload",
                F.when((number == 1) | F.arrays_overlap(taints, F.array(F.lit("Decoded"), F.lit("Deobfuscated"))), HIGH).otherwise(MEDIUM),
                name,
            )
        ],
    }


def fact_findings(f: Column | Mapping[str, Column], extra: Sequence[Rule] = ()) -> Column:
    """Findings of one fact, a struct or its fields by name, by the rules of the catalogue and those given: an array of structs.

    A fact is looked at by the rules of its kind alone, and by those given.
    """
    if len({r.code for r in extra}) < len(extra):
        raise ValueError("two rules have one code")
    every = F.array().cast(f"array<{FINDING}>")
    chain = F
    for kind, rules in _by_kind(f).items():
        chain = chain.when(f["kind"] == kind, F.array(*rules))
    every = chain.otherwise(every)
    if extra:
        every = F.concat(every, F.array(*[r.finding({n: f[n] for n in _FIELDS}) for r in extra]))
    return F.filter(every, lambda x: x.isNotNull())


def _literal_rules(text: Column, how: Column, number: Column) -> list[Column]:
    # the number of a literal says which pattern it holds first; import statements do not count in prose
    at = F.when(T.doc_like(text), F.floor(number / SPAN).cast("int")).otherwise(number % SPAN)
    findings = _table([{"rule": r, "confidence": c, "label": p, "description": d} for p, d, c, r in C.LITERAL_PATTERNS], "rule string, confidence int, label string, description string")
    long_enough = F.octet_length(text).between(*C.LITERAL_BYTES)
    pattern = F.when(number > 0, F.get(findings, at - 1))
    shown = T.preview(text)
    # decoded text is shown as the escapes of its bytes
    decoded = F.when(how.isin("Base64", "Hex") & ~text.rlike(r"\A(?:\\x[0-9a-f]{2})+\z"), T.preview(F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-8"))), "(..)", r"\\x$1"))).otherwise(shown)
    base = (how == "Base64") | (how == "") & T.long_base64(text)
    return [
        pattern,
        _finding(long_enough & T.telegram_token(text), "TelegramToken", MEDIUM, shown),
        _finding(base, "Base64String", F.when(F.octet_length(text) > C.BASE64_HIGH, HIGH).otherwise(MEDIUM), decoded),
        _finding(~base & ((how == "Hex") | T.long_hex(text)), "HexedString", MEDIUM, decoded),
    ]


def _exec_rules(name: Column, text: Column, how: Column, taints: Column, number: Column) -> list[Column]:
    """The decision: dangerous commands first, then what is run, how hidden, and how sure."""
    flag = lambda bit: number.bitwiseAND(bit) > 0
    sus, python = flag(SUSPICIOUS), flag(PYTHON)
    taint = F.get(taints, 0)  # taints come in order of precedence
    hidden = (taint.isNotNull() & (taint != "EnvVariables")) | sus
    shell = (how == "shell") & ~python
    parts = F.split(text, "\0")  # of a command's parts only the first names a program
    dangerous = shell & (T.dangerous_command(parts[0]) | F.coalesce(F.exists(F.slice(parts, 2, F.size(parts)), lambda x: T.dangerous_command(x, False)), F.lit(False)))
    level = F.when(taint.isin("Fingerprinting", "EnvVariables"), MEDIUM).when(taint.isNotNull() | sus, HIGH).otherwise(MEDIUM)
    level = F.when(sus & ~taint.eqNullSafe("EnvVariables"), VERY_HIGH).otherwise(level)
    level = F.when(flag(EXTRA), VERY_HIGH).when(flag(LEAST_HIGH), F.greatest(level, F.lit(HIGH))).otherwise(level)
    return [
        _finding(dangerous, "DangerousExec", F.when(flag(HARD_SUBJECT), VERY_HIGH).otherwise(HIGH), name),
        _finding(shell & ~dangerous & ~hidden, "ShellExec", level, name),
        _finding(shell & ~dangerous & hidden, "ObfuscatedShellExec", level, name),
        _finding(~shell & (~hidden | python), "CodeExec", level, name),
        _finding(~shell & hidden & ~python, "ObfuscatedCodeExec", level, name),
    ]


def found_in(facts: Column, path: Column, extra: Sequence[Rule] = ()) -> Column:
    """The findings of a file's facts, in their order: an array of structs.

    Findings of a setup.py are a level higher for the rules that execute,
    fingerprint or send.  No facts give no findings.
    """
    of = lambda f: F.transform(fact_findings(f, extra), lambda x: F.struct(*[f[n].alias(n) for n in _PLACE], x["rule"].alias("rule"), _elevated(x, path), x["label"].alias("label"), x["description"].alias("description")))
    return F.flatten(F.transform(F.coalesce(facts, F.array().cast(f"array<{FACT}>")), of))


def _elevated(finding: Column, path: Column) -> Column:
    is_setup = F.lower(F.regexp_extract(path, r"([^/\\\\]*)$", 1)).endswith("setup.py")
    up = F.coalesce(is_setup, F.lit(False)) & finding["rule"].isin(C.SETUP_ELEVATED) & (finding["confidence"] < HIGH)
    return (finding["confidence"] + up.cast("int")).alias("confidence")


def with_findings(analysed: DataFrame, extra: Sequence[Rule] = ()) -> DataFrame:
    """``analysed`` (file_path, facts, ...) with the column ``findings``."""
    return analysed.withColumn("findings", found_in(F.col("facts"), F.col("file_path"), extra))


def findings(analysed: DataFrame, extra: Sequence[Rule] = ()) -> DataFrame:
    """One row per finding of ``analysed`` (file_id, file_path, facts, ...), in order within a file."""
    rows = analysed.select("file_id", "file_path", F.explode("facts").alias("f")).select("file_id", "file_path", "f.*")
    fact = {name: F.col(name) for name in _FIELDS}
    rows = rows.select("file_id", "file_path", *_PLACE, F.explode(fact_findings(fact, extra)).alias("x"))
    return rows.select("file_id", "file_path", *_PLACE, "x.rule", _elevated(F.col("x"), F.col("file_path")), "x.label", "x.description")


def audit(sources: DataFrame, extra: Sequence[Rule] = ()) -> DataFrame:
    return findings(with_facts(sources), extra)


def chosen(found: DataFrame, least: int = LOW, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Findings of at least a confidence, of included codes (all where none is named) and no excluded one."""
    keep = F.col("confidence") >= least
    if include:
        keep &= F.col("rule").isin(list(include))
    return found.where(keep & ~F.col("rule").isin(list(exclude)) if exclude else keep)
