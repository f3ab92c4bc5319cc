"""Facts of one source file, by abstract evaluation of its syntax tree.

Code is data here: it is parsed, folded and named, and never run.  Every
expression gets a value: its text where that is constant, how the text came
about, the qualified name it stands for, its taints, and the parameters that
flow into it.  Statements are walked in source order, so that a name means
what was bound to it so far.
"""

from __future__ import annotations

import ast
import base64
import binascii
import builtins
import io
import re
import textwrap
import tokenize
from dataclasses import dataclass, replace

from larkspur.functions import catalogue as C
from larkspur.functions.encodings import decode_bytes

MAX_DEPTH, MAX_REPAIRS = 8, 60
#: Characters that the folded texts of a file may have in all; beyond it an ``error`` fact is given and a text is not folded.
MAX_FOLDED = 64_000_000
#: Statements of local functions that a file's calls may evaluate once more; beyond it an ``error`` fact is given.
MAX_INLINED = 500_000
#: Elements that a file's comprehensions and joined lists may have in all; beyond it an ``error`` fact is given and no elements are known.
MAX_ELEMENTS = 200_000
HARD = {"Decoded", "Deobfuscated"}
_SHELL, _CODE, _SINKS, _DOWNLOADS = map(frozenset, (C.SHELL_COMMANDS, C.CODE_EXEC, C.EXFIL_SINKS, C.DOWNLOADS))
_SOURCE_OF = {name: kind for kind, names in C.CALL_TAINTS.items() for name in names}
_URLLIB = re.compile(C.EXFIL_URLLIB)
_BUILTINS = frozenset(dir(builtins)) | {"__builtins__", "builtins", "execfile", "unicode", "xrange"}
_ARGV_AT = {"execv": 1, "execve": 1, "execvp": 1, "execvpe": 1, "posix_spawn": 1, "posix_spawnp": 1, "spawnv": 2, "spawnve": 2, "spawnvp": 2, "spawnvpe": 2}


@dataclass(frozen=True)
class Value:
    text: str | None = None
    raw: str | None = None
    how: str = ""
    path: str | None = None
    taints: frozenset = frozenset()
    items: tuple | None = None
    pairs: tuple = ()
    number: int | None = None
    function: object = None
    params: frozenset = frozenset()
    hint: str = ""  # what is known of a text that is not wholly constant
    data: bytes | None = None


#: Flags of an ``exec`` fact.
EXTRA, SUSPICIOUS, PYTHON, LEAST_HIGH, HARD_SUBJECT = 1, 2, 4, 8, 16
NOTHING = Value()


@dataclass(eq=False)
class Function:
    names: list
    returns: list
    leaks: list
    body: object = None


#: A dotted name of two or more identifiers.
_DOTTED = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)+")
_TOKEN = re.compile(r"""#[^\n]*|'{3}|"{3}|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|[()\[\]{}]|\\\n|\n|[^#'"()\[\]{}\\\n]+|.""", re.S)
_CLAUSE = re.compile(r"\s*(?:elif|else|except|finally|case)\b|\s*[)\]}]")
_STATEMENT = re.compile(r"\s*(?:def|class|import|from|return|while|try|with|print|exec|raise|del|global|assert|async|@)\b")


def _starts(lines: list[str]) -> list[bool]:
    """Whether a statement can begin at each line: not within a long string, nor within brackets (an unclosed one ends at a statement's keyword)."""
    out, depth, text = [True], 0, "\n".join(lines)
    at = 0
    while at < len(text):
        token = _TOKEN.match(text, at)
        at, t = token.end(), token[0]
        if t in ("'''", '"""'):
            end = text.find(t, at)
            while end > 0 and text[end - 1] == "\\":
                end = text.find(t, end + 1)
            end = len(text) if end < 0 else end + 3
            out += [False] * text.count("\n", at, end)
            at = end
        elif t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(depth - 1, 0)
        elif t == "\\\n":
            out.append(False)
        elif t == "\n":
            if depth and _STATEMENT.match(text, at):
                depth = 0
            out.append(depth == 0)
    return out


def _modern(line: str) -> str:
    """A line of the old syntax in the new one."""
    line = re.sub(r"^(\s*)except\s+([^:()]+?|\([^()]*\))\s*,\s*(\w+)\s*:", r"\1except \2 as \3:", line)
    line = re.sub(r"^(\s*)raise\s+([\w.]+)\s*,\s*(.+)$", r"\1raise \2(\3)", line)
    # with >> the stream becomes one more argument
    return re.sub(r"^(\s*)(print|exec)\b\s*(?!\()(?:>>\s*)?([^#\s=,.\[:+*/%&|^)\]}-].*)$", r"\1\2(\3)", line)


#: A hexadecimal escape that lacks digits.
_BROKEN_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)\\(?=x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8}))")


def _parses(lines: list[str], lo: int, hi: int) -> bool:
    block = lines[lo:hi]
    indented = next((x for x in block if x.strip()), "")[:1].isspace()
    try:
        ast.parse("\n".join(["if 1:", *block, ""] if indented else block))
        return True
    except SyntaxError:
        return False


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _settle(lines: list[str], begins: list[bool], lo: int, hi: int) -> None:
    """Edits ``lines[lo:hi]`` statement by statement until it parses as one block; what cannot be read becomes ``pass``."""
    full = [i for i in range(lo, hi) if lines[i].strip() and begins[i] and not lines[i].lstrip().startswith("#")]
    if not full or _parses(lines, lo, hi):
        return
    least = min(_indent(lines[i]) for i in full)
    for i in full[: full.index(next(i for i in full if _indent(lines[i]) == least))]:
        lines[i] = " " * least + lines[i].lstrip()  # deeper than the block that it opens
    heads = [i for i in full if _indent(lines[i]) == least and not _CLAUSE.match(lines[i])] or full[:1]
    if heads[0] != full[0]:
        heads = [full[0], *heads]
    if len(heads) > 1:
        for a, b in zip(heads, [*heads[1:], hi]):
            _settle(lines, begins, a, b)
        return
    # one statement: its blocks, then the lines that open them
    inner = [i for i in full if _indent(lines[i]) == least]
    bodies = [(a, [k for k in full if a < k < b]) for a, b in zip(inner, [*inner[1:], hi])]
    ends = [*inner[1:], hi]
    for (a, body), b in zip(bodies, ends):
        if body:
            _settle(lines, begins, body[0], b)
    if _parses(lines, lo, hi):
        return
    for (a, body), b in zip(bodies, ends):
        first = body[0] if body else b
        lone = lines[a:first] + ([" " * (least + 1) + "pass"] if body else [])
        if body or not _parses(lone, 0, len(lone)):
            for k in range(a, first):
                lines[k] = ""
            lines[a] = " " * least + ("if 1:" if body else "pass")


def parse(source: str) -> tuple[ast.Module | None, str]:
    """The tree, after repairs of lines that do not parse, and the text it belongs to.

    Old-style lines are repaired at once, then single bad lines; a text with
    more than ``MAX_REPAIRS`` of them is read statement by statement.
    """
    text, seen = source, set()
    try:
        for attempt in range(MAX_REPAIRS):
            try:
                return ast.parse(text), text
            except SyntaxError as error:
                if attempt == 0 and text[:1].isspace():
                    text = textwrap.dedent(text)
                    continue
                lines = text.replace("\0", " ").split("\n")
                at = min(max((error.lineno or 1) - 1, 0), len(lines) - 1)
                line = lines[at]
                old_style = re.sub(r"^(\s*)(print|exec)\b\s*(?!\()(.*)$", r"\1\2(\3)", line)
                if not seen and (modern := [_modern(x) if b else x for x, b in zip(lines, _starts(lines))]) != lines:
                    lines = modern
                elif at not in seen and old_style != line:
                    lines[at] = old_style
                elif re.search(r"codec can't decode|invalid \\x escape", error.msg or "") and (whole := [_BROKEN_ESCAPE.sub(r"\1/", x) for x in lines]) != lines:
                    lines = whole  # of the same length, so places stay
                else:
                    lines[at] = line[: len(line) - len(line.lstrip())] + ("pass" if line.strip() != "pass" else "")
                seen.add(at)
                text = "\n".join(lines)
        lines = source.replace("\0", " ").replace("\f", " ").split("\n")
        begins = _starts(lines)
        lines = [_BROKEN_ESCAPE.sub(r"\1/", _modern(x[: _indent(x)].expandtabs() + x.lstrip()) if b else x) for x, b in zip(lines, begins)]
        _settle(lines, begins, 0, len(lines))
        text = "\n".join(lines)
        return ast.parse(text), text
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, text


def unquoted(segment: str) -> str:
    """The text between the quotes of a literal, escapes left as they are; adjacent literals are joined."""
    parts = re.findall(r"""[rRbBuUfF]*('''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")""", segment)
    return "".join(p[3:-3] if p[:3] in ("'''", '"""') else p[1:-1] for p in parts)


def escaped(data: bytes) -> str:
    """Bytes as text: UTF-8 where they are that, else hexadecimal escapes."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in data)


def decoded(name: str, text: str) -> tuple[str, str] | None:
    """Result and kind of a decoding call on constant text."""
    try:
        if name in ("base64.b64decode", "binascii.a2b_base64"):
            return escaped(base64.b64decode(text.strip(), validate=True)), "Base64"
        if name == "base64.urlsafe_b64decode":
            return escaped(base64.urlsafe_b64decode(text.strip())), "Base64"
        if name in ("bytes.fromhex", "binascii.unhexlify"):
            return escaped(bytes.fromhex(text)), "Hex"
    except (ValueError, binascii.Error):
        return None
    return None


def mode_of(given: list[Value], named: dict) -> str:
    """The mode of a call that opens a file; reading where none is known."""
    return (given[0] if given else named.get("mode", NOTHING)).text or "r"


def reads(mode: str) -> bool:
    return bool(set(mode) & set("r+")) or not set(mode) & set("wax")


class Walk:
    """One pass over a tree; ``facts`` holds what it found."""

    def __init__(self, source: str, is_setup: bool = False, depth: int = 0, outer: tuple[int, int] | None = None):
        self.tree, self.source = parse(source)
        self.is_setup, self.depth, self.outer = is_setup, depth, outer
        self.given_up = self.tree is not None and self.source != source and all(isinstance(s, ast.Pass) for s in self.tree.body)
        self.data = self.source.encode("utf-8", "replace")
        starts = [0]
        for line in self.data.split(b"\n"):
            starts.append(starts[-1] + len(line) + 1)
        self.starts = starts
        self.scopes: list[dict[str, Value]] = [{}]
        self.functions: list[Function] = []
        self.classes: list[dict[str, Value]] = []
        self.facts: list[dict] = []
        self.modules: set[str] = set()
        self.inlined, self.inline_depth = 0, 0
        self.unread: ast.Call | None = None
        self.elements, self.uncounted = 0, None
        self.folded, self.unfolded = 0, None
        self.results: dict[tuple, list[Value]] = {}
        self.used: dict[Function, tuple[frozenset, int]] = {}

    # -- facts ---------------------------------------------------------
    def span(self, node: ast.AST) -> tuple[int, int]:
        if self.outer:
            return self.outer
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def emit(self, kind: str, node: ast.AST | tuple[int, int], name: str | None, text: str | None = None, how: str = "", taints=(), number: int = 0) -> dict:
        start, end = node if isinstance(node, tuple) else self.span(node)
        fact = {"kind": kind, "ord": len(self.facts), "start": start, "end": end, "name": name, "text": text, "how": how, "taints": [t for t in C.TAINT_ORDER if t in taints], "number": number, "depth": self.depth}
        self.facts.append(fact)
        return fact

    def run(self) -> list[dict]:
        self.comments()
        if self.tree is not None:
            self.body(self.tree.body)
        # a text of which every statement was given up is not read either; within other texts that is mere prose
        if self.tree is None or (not self.depth and self.given_up):
            self.emit("error", self.outer or (0, 0), "not parsed")
        if self.unfolded is not None:
            self.emit("error", self.unfolded, "texts too long to fold")
        if self.unread is not None:
            self.emit("error", self.unread, "calls not evaluated")
        if self.uncounted is not None:
            self.emit("error", self.uncounted, "too many elements to evaluate")
        if not self.depth:
            first = {"dynamic_import": 0, "comment": 1}
            self.facts.sort(key=lambda f: first.get(f["kind"], 2) if f["depth"] == 0 else 2)
            for i, f in enumerate(self.facts):
                f["ord"] = i
        return self.facts

    def comments(self) -> None:
        if "#" not in self.source:  # reading tokens is a good part of the work on a small file
            return
        try:
            for token in tokenize.generate_tokens(io.StringIO(self.source).readline):
                if token.type == tokenize.COMMENT:
                    line = token.line[: token.start[1]].encode("utf-8", "replace")
                    at = self.starts[token.start[0] - 1] + len(line)
                    self.emit("comment", self.outer or (at, at + len(token.string.encode("utf-8", "replace"))), None, token.string)
        except (tokenize.TokenError, SyntaxError, IndexError):
            pass

    def nested(self, text: str | None, node: ast.AST) -> None:
        """Facts of a source text inside this one, at the place of the outer expression."""
        if text and len(text) > 4 and re.search(r"[(=]|import ", text):
            if self.depth >= MAX_DEPTH:
                self.emit("error", node, "nested too deep")
                return
            inner = Walk(text.replace("\\n", "\n"), False, self.depth + 1, self.span(node))
            if inner.tree is not None:
                for f in inner.run():
                    f["ord"] = len(self.facts)
                    self.facts.append(f)
            else:
                self.emit("error", node, "nested text not parsed")

    # -- statements ----------------------------------------------------
    def body(self, statements: list[ast.stmt]) -> None:
        for s in statements:
            self.statement(s)

    def bind(self, target: ast.expr, value: Value, node: ast.AST) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            same = value.items is not None and len(value.items) == len(target.elts)
            for i, t in enumerate(target.elts):
                self.bind(t, value.items[i] if same else replace(value, items=None, text=None), node)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, value, node)
        elif isinstance(target, ast.Name):
            self.emit("target", target, target.id)
            self.scopes[-1][target.id] = value
        elif isinstance(target, ast.Attribute):
            self.emit("target", target, target.attr)
            if isinstance(target.value, ast.Name) and target.value.id == "self" and self.classes:
                self.classes[-1][target.attr] = value
            else:
                self.value(target.value)
        elif isinstance(target, ast.Subscript):
            key, owner = self.value(target.slice), self.value(target.value)
            if key.text is not None:
                self.emit("target", target, key.text)
            if isinstance(target.value, ast.Name) and value.taints:
                self.scopes[-1][target.value.id] = replace(owner, taints=owner.taints | value.taints)

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, ast.Import):
            for a in s.names:
                self.emit("import", s, a.name)
                self.modules.add(a.name.split(".")[0])
                self.emit("target", a, a.asname or a.name)
                self.scopes[-1][a.asname or a.name.split(".")[0]] = Value(path=a.name if a.asname else a.name.split(".")[0])
        elif isinstance(s, ast.ImportFrom):
            base = "." * s.level + (s.module or "")
            self.emit("import", s, base)
            self.modules.add((s.module or "").split(".")[0])
            for a in s.names:
                if a.name != "*":
                    if s.module:
                        self.emit("target", a, a.asname or a.name)
                    self.scopes[-1][a.asname or a.name] = Value(path=f"{base}.{a.name}")
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s)
        elif isinstance(s, ast.ClassDef):
            self.klass(s)
        elif isinstance(s, ast.Assign):
            value = self.value(s.value)
            for t in s.targets:
                self.bind(t, value, s)
        elif isinstance(s, ast.AnnAssign):
            self.bind(s.target, self.value(s.value) if s.value else NOTHING, s)
        elif isinstance(s, ast.AugAssign):
            value = self.value(s.value)
            old = self.value(s.target) if isinstance(s.target, (ast.Name, ast.Attribute)) else NOTHING
            if isinstance(s.target, ast.Name):
                both = old.text is not None and value.text is not None and isinstance(s.op, ast.Add)
                joined = old.text + value.text if both and self.may_fold(s, len(old.text) + len(value.text)) else None
                self.scopes[-1][s.target.id] = Value(text=joined, how=old.how or value.how, taints=old.taints | value.taints, params=old.params | value.params)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            over = self.value(s.iter)
            self.bind(s.target, Value(taints=over.taints, params=over.params), s)
            self.body(s.body + s.orelse)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                value = self.value(item.context_expr)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, value, s)
            self.body(s.body)
        elif isinstance(s, (ast.If, ast.While)):
            self.value(s.test)
            self.body(s.body + s.orelse)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            self.body(s.body)
            for h in s.handlers:
                if h.name:
                    self.scopes[-1][h.name] = NOTHING
                self.body(h.body)
            self.body(s.orelse + s.finalbody)
        elif isinstance(s, ast.Return):
            value = self.value(s.value) if s.value else NOTHING
            if self.functions:
                self.functions[-1].returns.append(value)
        elif isinstance(s, ast.Match):
            self.value(s.subject)
            for case in s.cases:
                self.body(case.body)
        else:
            for child in ast.iter_child_nodes(s):
                if isinstance(child, ast.expr):
                    self.value(child)

    def arguments(self, a: ast.arguments) -> list[ast.arg]:
        return [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]

    def function(self, s) -> None:
        self.emit("def", s, s.name)
        for d in [*s.decorator_list, *s.args.defaults, *(k for k in s.args.kw_defaults if k)]:
            self.value(d)
        params = self.arguments(s.args)
        made = Function([p.arg for p in params], [], [])
        self.functions.append(made)
        self.scopes.append({p.arg: Value(params=frozenset([p.arg])) for p in params})
        for p in params:
            self.emit("param", p, p.arg)
        self.body(s.body)
        self.scopes.pop()
        self.functions.pop()
        made.body = s.body
        self.scopes[-1][s.name] = Value(function=made)

    def klass(self, s: ast.ClassDef) -> None:
        bases = [self.value(b).path or (b.id if isinstance(b, ast.Name) else "") for b in s.bases]
        self.classes.append({})
        self.scopes.append({})
        self.body(s.body)
        scope = self.scopes.pop()
        self.classes.pop()
        hooks = [b for b in bases if b.rsplit(".", 1)[-1] in ("install", "Command", "develop", "egg_info", "build_py")]
        if self.is_setup and hooks and {"run", "__init__"} & set(scope):
            self.emit("hook", s, s.name, number=1)
        self.scopes[-1][s.name] = Value(path=None)

    # -- expressions ---------------------------------------------------
    def lookup(self, name: str) -> Value:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        return Value(path=name) if name in _BUILTINS else Value()

    def value(self, e: ast.expr | None) -> Value:
        if e is None:
            return NOTHING
        handler = getattr(self, f"on_{type(e).__name__}", None)
        if handler:
            return handler(e)
        taints, params = frozenset(), frozenset()
        for child in ast.iter_child_nodes(e):
            if isinstance(child, ast.expr):
                v = self.value(child)
                taints, params = taints | v.taints, params | v.params
        return Value(taints=taints, params=params)

    def may_fold(self, node: ast.AST, characters: int) -> bool:
        """Whether a text of so many characters may still be made; asked before it is."""
        self.folded += characters
        if self.folded > MAX_FOLDED:
            self.unfolded = self.unfolded or self.span(node)
        return self.folded <= MAX_FOLDED

    def may_hold(self, node: ast.AST, elements: int) -> bool:
        """Whether so many elements may still be evaluated or joined; asked before they are."""
        self.elements += elements
        if self.elements > MAX_ELEMENTS:
            self.uncounted = self.uncounted or self.span(node)
        return self.elements <= MAX_ELEMENTS

    def literal(self, e: ast.expr, v: Value) -> Value:
        text = v.raw if v.raw is not None else v.text
        if v.how and text is not None and not self.may_fold(e, len(text)):
            return replace(v, text=None, raw=None, hint="")
        if v.how:  # a folded text stands for all that it was made of
            start, end = self.span(e)
            for f in reversed(self.facts):
                if f["start"] < start or f["end"] > end:
                    break
                if f["kind"] in ("literal", "numbers") and f["depth"] == self.depth:
                    f["kind"] = "part"
        self.emit("literal", e, None, text, v.how, v.taints)
        return v

    def on_Constant(self, e: ast.Constant) -> Value:
        if isinstance(e.value, (str, bytes)):
            start, end = self.starts[e.lineno - 1] + e.col_offset, self.starts[e.end_lineno - 1] + e.end_col_offset
            raw = unquoted(self.data[start:end].decode("utf-8", "replace"))
            text = e.value if isinstance(e.value, str) else escaped(e.value)
            self.plain_nested(e, text)
            return self.literal(e, Value(text=text, raw=raw, data=e.value if isinstance(e.value, bytes) else None))
        if isinstance(e.value, int) and not isinstance(e.value, bool):
            return Value(number=e.value)
        return NOTHING

    def plain_nested(self, e: ast.expr, text: str) -> None:
        if len(text) >= 2 * C.BASE64_LEAST and len(text.strip()) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+=*", text.strip()):
            got = decoded("base64.b64decode", text)
            if got and got[0].replace("\n", "").replace("\t", "").isprintable() and "\\x" not in got[0]:
                self.nested(got[0], e)

    def on_JoinedStr(self, e: ast.JoinedStr) -> Value:
        parts, taints, params = [], frozenset(), frozenset()
        for p in e.values:
            if isinstance(p, ast.Constant):
                parts.append(str(p.value))
                continue
            v = self.value(p.value)
            taints, params = taints | v.taints, params | v.params
            parts.append(v.text if v.text is not None else f"{{{p.value.id}}}" if isinstance(p.value, ast.Name) else "")
        return self.literal(e, Value(text="".join(parts), how="FString", taints=taints, params=params))

    def on_Name(self, e: ast.Name) -> Value:
        return self.lookup(e.id)

    def on_Attribute(self, e: ast.Attribute) -> Value:
        return self.called(e)[0]

    def attribute(self, e: ast.Attribute, owner: Value) -> Value:
        if isinstance(e.value, ast.Name) and e.value.id == "self" and self.classes and e.attr in self.classes[-1]:
            return self.classes[-1][e.attr]
        path = f"{owner.path}.{e.attr}" if owner.path is not None else None
        taints = owner.taints | ({C.ATTRIBUTE_TAINTS[path]} if path in C.ATTRIBUTE_TAINTS else set())
        return Value(path=path, taints=frozenset(taints), params=owner.params, hint=owner.hint if path in C.PATH_WRITES or path == "pathlib.Path.open" else "")

    def on_BinOp(self, e: ast.BinOp) -> Value:
        a, b = self.value(e.left), self.value(e.right)
        keeps = not isinstance(e.op, (ast.Sub, ast.Div, ast.FloorDiv, ast.Pow, ast.MatMult))
        left, right = (v.text if v.text is not None else v.hint for v in (a, b))
        hint = left + right if isinstance(e.op, ast.Add) else left if isinstance(e.op, ast.Mod) else ""
        out = Value(taints=a.taints | b.taints if keeps else frozenset(), params=a.params | b.params, hint=hint)
        if isinstance(e.op, ast.Add) and a.text is not None and b.text is not None:
            return self.literal(e, replace(out, text=a.text + b.text, how=a.how or b.how or "Concat"))
        if isinstance(e.op, ast.Add) and a.items is not None and b.items is not None:
            return replace(out, items=a.items + b.items if self.may_hold(e, len(a.items) + len(b.items)) else None)
        if a.number is not None and b.number is not None:
            x, y = a.number, b.number
            try:
                n = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: int(x / y), ast.Mod: lambda: x % abs(y), ast.BitXor: lambda: x ^ y}.get(type(e.op), lambda: None)()
            except (ZeroDivisionError, OverflowError):
                n = None
            if n is not None and -(2**31) <= n < 2**31:
                return replace(out, number=n)
        return out

    def on_UnaryOp(self, e: ast.UnaryOp) -> Value:
        v = self.value(e.operand)
        return replace(v, number=-v.number) if isinstance(e.op, ast.USub) and v.number is not None else v

    def on_List(self, e) -> Value:
        items = tuple(self.value(x) for x in e.elts)
        ints = hexed = 0
        for x in e.elts:
            if isinstance(x, ast.Constant) and type(x.value) is int:
                ints += 1
                at = self.starts[x.lineno - 1] + x.col_offset
                hexed += self.data[at : at + 2].lower() == b"0x"
            elif not (isinstance(x, ast.Constant) and type(x.value) is float):
                break
        if hexed > C.HEXED_MORE_THAN or ints > C.INTS_MORE_THAN:
            shown = ", ".join(ast.get_source_segment(self.source, x) or "" for x in e.elts[:5])
            self.emit("numbers", e, f"[{shown}, ... ]", how="Hex" if hexed > C.HEXED_MORE_THAN else "Int", number=ints)
        return Value(items=items, taints=frozenset().union(*(i.taints for i in items)), params=frozenset().union(*(i.params for i in items)))

    on_Tuple = on_List

    def on_Dict(self, e: ast.Dict) -> Value:
        pairs = tuple((self.value(k), self.value(v)) for k, v in zip(e.keys, e.values))
        return Value(pairs=pairs, taints=frozenset().union(*(v.taints for _, v in pairs)), params=frozenset().union(*(v.params for _, v in pairs)))

    def on_Subscript(self, e: ast.Subscript) -> Value:
        owner = self.value(e.value)
        if isinstance(e.slice, ast.Slice):
            step = self.value(e.slice.step)
            whole = e.slice.lower is None and e.slice.upper is None and step.number == -1
            if whole and owner.text is not None:
                return self.literal(e, replace(owner, text=owner.text[::-1], raw=None, how="Subscript"))
            return replace(owner, items=owner.items[::-1]) if whole and owner.items else Value(taints=owner.taints, params=owner.params)
        key = self.value(e.slice)
        if owner.path == "os.environ" and key.text is not None:
            self.emit("env", e, key.text)
        if owner.items is not None and key.number is not None and -len(owner.items) <= key.number < len(owner.items):
            got = owner.items[key.number]
            return replace(got, taints=got.taints | {"Deobfuscated"}) if got.path in _SHELL | _CODE else got
        for k, v in owner.pairs:
            if k.text is not None and k.text == key.text:
                return replace(v, taints=v.taints | {"Deobfuscated"}) if v.path in _SHELL | _CODE else v
        if key.text is not None and owner.path is not None:
            if owner.path in C.REGISTRIES:
                return Value(path=key.text, taints=owner.taints | {"Deobfuscated"})
            if owner.path.endswith(".__dict__"):
                return Value(path=f"{owner.path[:-9]}.{key.text}", taints=owner.taints | {"Deobfuscated"})
        return Value(taints=owner.taints, params=owner.params)

    def on_Lambda(self, e: ast.Lambda) -> Value:
        made = Function([p.arg for p in self.arguments(e.args)], [], [])
        self.functions.append(made)
        self.scopes.append({p: Value(params=frozenset([p])) for p in made.names})
        made.returns.append(self.value(e.body))
        self.scopes.pop()
        self.functions.pop()
        return Value(function=made)

    def comprehension(self, e) -> Value:
        self.scopes.append({})
        over, taints, params = NOTHING, frozenset(), frozenset()
        for g in e.generators:
            over = self.value(g.iter)
            hidden = over.taints | {"Decoded"} if over.how in ("Base64", "Hex") else over.taints
            self.bind(g.target, Value(taints=hidden, params=over.params), e)
            taints, params = taints | hidden, params | over.params
        items = None
        elements = over.items if over.items is not None else tuple(Value(text=c) for c in over.text) if over.text is not None else None
        plain = len(e.generators) == 1 and isinstance(e.generators[0].target, ast.Name) and not e.generators[0].ifs
        if plain and elements is not None and not isinstance(e, ast.DictComp) and self.may_hold(e, len(elements)):
            quiet, kept = self.facts, []
            for element in elements:  # facts of the copies are not those of the source
                self.facts = []
                self.scopes[-1][e.generators[0].target.id] = element
                kept.append(self.value(e.elt))
            self.facts = quiet
            items = tuple(kept)
        out = self.value(e.value if isinstance(e, ast.DictComp) else e.elt)
        self.scopes.pop()
        return Value(items=items, taints=taints | out.taints, params=params | out.params)

    on_ListComp = on_GeneratorExp = on_SetComp = on_DictComp = comprehension

    def on_NamedExpr(self, e: ast.NamedExpr) -> Value:
        v = self.value(e.value)
        self.bind(e.target, v, e)
        return v

    # -- calls ---------------------------------------------------------
    def on_Call(self, e: ast.Call) -> Value:
        callee, receiver = self.called(e.func)
        args = [self.value(a.value if isinstance(a, ast.Starred) else a) for a in e.args]
        named = {k.arg: self.value(k.value) for k in e.keywords}
        qn = callee.path
        called = qn or self.chain(e.func)
        every = [*args, *named.values()]
        flow = frozenset().union(*(v.taints for v in every))
        params = frozenset().union(receiver.params, *(v.params for v in every))
        first = args[0] if args else NOTHING
        text = first.text if first.text is not None else named.get("key", NOTHING).text
        how = "direct" if isinstance(e.func, ast.Subscript) and isinstance(e.func.value, ast.Call) else ""
        self.emit("call", e, called, text, how, flow)
        method = e.func.attr if isinstance(e.func, ast.Attribute) else None
        if isinstance(e.func, (ast.Name, ast.Attribute)):
            self.emit("called", e, method or e.func.id)
        if method in C.MUTATORS and isinstance(e.func.value, ast.Name):
            self.mutate(e.func.value.id, method, args)
        if how and isinstance(e.func.slice, ast.Constant) and e.func.slice.value in ("__builtins__", "builtins"):
            self.emit("builtins", e, called)
        self.detect(e, qn, callee, args, named, flow)
        if callee.function is not None:
            return self.inline(e, callee, args, named, flow, params)
        out = self.fold(e, qn, method, receiver, args, named)
        taints = set(flow)
        if qn in _SOURCE_OF:
            taints.add(_SOURCE_OF[qn])
        if qn in ("open", "io.open") and reads(mode_of(args[1:2], named)):
            taints.add("FileSourced")
        if method in C.RECEIVER_METHODS or callee.taints & HARD:
            taints |= receiver.taints | callee.taints
        if qn in C.TAINT_STOPPERS:
            taints = set()
        if out.how in ("Base64", "Hex", "Other"):
            taints |= HARD
        kept = replace(out, taints=frozenset(taints | out.taints), params=params)
        return self.literal(e, kept) if kept.text is not None else kept

    def called(self, e: ast.expr) -> tuple[Value, Value]:
        """The values of a call's function and of the object it is a method of."""
        if not isinstance(e, ast.Attribute):
            return self.value(e), NOTHING
        owner = self.value(e.value)
        return self.attribute(e, owner), owner

    def chain(self, e: ast.expr) -> str | None:
        parts = []
        while isinstance(e, ast.Attribute):
            parts.append(e.attr)
            e = e.value
        return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None

    def mutate(self, name: str, method: str, args: list[Value]) -> None:
        old = self.lookup(name)
        items = old.items
        if items is not None:
            if method == "append" and args:
                items = (*items, args[0])
            elif method == "extend" and args and args[0].items is not None:
                items = items + args[0].items
            elif method == "reverse":
                items = items[::-1]
            elif method == "insert" and len(args) == 2 and args[0].number is not None:
                items = (*items[: args[0].number], args[1], *items[args[0].number :])
        self.scopes[-1][name] = replace(old, items=items, taints=old.taints.union(*(a.taints for a in args)))

    def call_key(self, made: Function, given: dict) -> tuple:
        """All that the result of a call depends on: its arguments and what the names in the body mean now."""
        todo, met, seen = [made], [], set()
        while todo:
            f = todo.pop()
            if f in seen:
                continue
            seen.add(f)
            if f not in self.used:
                nodes = [n for s in f.body or [] for n in ast.walk(s)]
                self.used[f] = frozenset(n.id for n in nodes if isinstance(n, ast.Name)), sum(isinstance(n, ast.stmt) for n in nodes)
            for name in sorted(self.used[f][0] - given.keys() if f is made else self.used[f][0]):
                v = self.lookup(name)
                met.append((name, v))
                if v.function is not None:
                    todo.append(v.function)
        return made, self.inline_depth, tuple(sorted(given.items(), key=lambda x: str(x[0]))), tuple(met), tuple(self.classes[-1].items()) if self.classes else ()

    def inline(self, e: ast.Call, callee: Value, args: list[Value], named: dict, flow: frozenset, params: frozenset) -> Value:
        made: Function = callee.function
        given = dict(zip(made.names, args)) | named
        for param, kind, label, hard in made.leaks:
            v = given.get(param)
            if v is None:
                continue
            if kind == "exfil" and v.taints:
                self.emit("exfil", e, self.chain(e.func) or label, taints=v.taints)
            elif kind in ("shell", "code") and any(v is a for a in args):
                self.emit("exec", e, self.chain(e.func) or label, v.text, kind, v.taints, number=LEAST_HIGH | (SUSPICIOUS | HARD_SUBJECT if self.hard([v]) else 0))
            for q in v.params:
                if self.functions:
                    self.functions[-1].leaks.append((q, kind, label, hard))
        returns = made.returns
        if made.body and self.inline_depth < 2 and given and (key := self.call_key(made, given)) in self.results:
            returns = self.results[key] + returns
        elif made.body and self.inline_depth < 2 and given and self.inlined >= MAX_INLINED:
            self.unread = self.unread or e
        elif made.body and self.inline_depth < 2 and given:
            # once more with what this call passes; the facts are recorded already
            self.inlined, self.inline_depth = self.inlined + self.used[made][1], self.inline_depth + 1
            kept, self.facts = self.facts, []
            self.scopes.append(given)
            self.functions.append(Function(made.names, [], []))
            self.body(made.body)
            self.results[key] = self.functions.pop().returns
            returns = self.results[key] + returns
            self.scopes.pop()
            self.facts, self.inline_depth = kept, self.inline_depth - 1
        taints = flow.union(*(r.taints for r in returns))
        path = next((r.path for r in returns if r.path is not None), None)
        text = next((r.text for r in returns if r.text is not None), None)
        return Value(path=path, text=text, taints=taints, params=params)

    @staticmethod
    def hard(values: list[Value]) -> bool:
        return any(v.how in ("Base64", "Hex", "Other") or v.taints & HARD for v in values)

    def joined(self, v: Value) -> list[str] | None:
        if v.text is not None:
            return list(v.text)
        if v.items is not None and all(i.text is not None for i in v.items):
            return [i.text for i in v.items]
        return None

    def fold(self, e: ast.Call, qn: str | None, method: str | None, receiver: Value, args: list[Value], named: dict) -> Value:
        first = args[0] if args else NOTHING
        second = args[1] if len(args) > 1 else NOTHING
        if first.text is not None and qn and (got := decoded(qn, first.text)):
            return Value(text=got[0], how=got[1])
        if qn in C.IMPORT_CALLS and first.text is not None:
            self.emit("dynamic_import", e, first.text)
            self.modules.add(first.text.split(".")[0])
            return Value(path=first.text, taints=frozenset(["Deobfuscated"]))
        if (qn in C.GETATTR or method in ("__getattribute__", "__getattr__", "getattr")) and (key := second if qn in C.GETATTR else first).text is not None:
            owner = first if qn in C.GETATTR else receiver
            hard = {"Deobfuscated"} if key.text in C.SENSITIVE_ATTRIBUTES else set()
            return Value(path=f"{owner.path}.{key.text}" if owner.path is not None else None, taints=owner.taints | hard)
        if qn in ("eval", "builtins.eval") and first.text is not None and _DOTTED.fullmatch(first.text):
            return Value(path=first.text, taints=frozenset(["Deobfuscated"]))
        if method == "get" and receiver.path in C.REGISTRIES and first.text is not None:
            return Value(path=first.text, taints=frozenset(["Deobfuscated"]))
        if qn in ("globals", "locals", "vars"):
            return Value(path=f"{first.path}.__dict__" if first.path else qn)
        if qn in C.CONSTRUCTORS:
            return Value(path="pathlib.Path" if qn == "Path" else qn, params=first.params, hint=first.text or first.hint)
        if qn == "chr" and first.number is not None and 0 <= first.number < 0x110000:
            return Value(text=chr(first.number), how="Other")
        if qn == "ord" and first.text is not None and len(first.text) == 1:
            return Value(number=ord(first.text))
        if qn in ("bytes", "bytearray") and first.items and all(i.number is not None and 0 <= i.number < 256 for i in first.items):
            return Value(text=escaped(bytes(i.number for i in first.items)), how="Other")
        if qn in ("str", "bytes", "compile", "list", "tuple", "bytearray") and args:
            return replace(first, raw=None, path=None)
        if qn == "reversed" and args:
            parts = self.joined(first)
            return Value(items=tuple(Value(text=p) for p in reversed(parts))) if parts is not None else replace(first, items=first.items[::-1] if first.items else None)
        if qn == "map" and first.path == "chr" and second.items and all(i.number is not None and 0 <= i.number < 0x110000 for i in second.items):
            return Value(items=tuple(Value(text=chr(i.number), how="Other") for i in second.items))
        if qn == "os.path.join" and args:
            if all(a.text is not None for a in args):
                return Value(text="/".join(a.text for a in args), how="Concat")
            return Value(hint="/".join(a.text or a.hint or a.path or "" for a in args))
        if qn == "os.path.expanduser" and first.text is not None:
            return replace(first, raw=None)
        if receiver.text is not None:
            return self.text_method(receiver, method, args)
        return Value(path=qn)

    def text_method(self, receiver: Value, method: str | None, args: list[Value]) -> Value:
        s = receiver.text
        texts = [a.text for a in args]
        if method == "join" and args and (parts := self.joined(args[0])) is not None:
            how = next((i.how for i in args[0].items or () if i.how), "") or "Join"
            return Value(text=s.join(parts), how=how)
        if method == "decode" and receiver.data is not None and texts and texts[0]:
            text = decode_bytes(receiver.data, texts[0])
            return NOTHING if text is None else Value(text=text, how="Other")
        if method == "decode":
            return replace(receiver, raw=None, how=receiver.how or "Other")
        if method == "encode" or method == "format" and not args:
            return replace(receiver, raw=None)
        if method == "replace" and len(texts) == 2 and None not in texts:
            return replace(receiver, text=s.replace(*texts), raw=None)
        if method in ("strip", "lstrip", "rstrip") and None not in texts and len(texts) < 2:
            return replace(receiver, text=getattr(s, method)(*texts), raw=None)
        if method in ("lower", "upper"):
            return replace(receiver, text=getattr(s, method)(), raw=None)
        return NOTHING

    def leak(self, kind: str, label: str, values: list[Value]) -> None:
        for v in values:
            for p in v.params:
                if self.functions and p in self.functions[-1].names and (p, kind, label, False) not in self.functions[-1].leaks:
                    self.functions[-1].leaks.append((p, kind, label, False))

    def execution(self, e: ast.Call, qn: str, callee: Value, args: list[Value], named: dict) -> None:
        """A call that runs a command or code: what it runs, whether through Python, and how hidden that is."""
        first = args[0] if args else NOTHING
        kind = "shell" if qn in _SHELL else "code"
        at = _ARGV_AT.get(qn.rsplit(".", 1)[-1], 0)
        subjects = [*args[at : at + 1], *(named[k] for k in ("args", "executable", "source", "object", "expression", "target") if k in named)]
        parts = ["python" if v.path == "sys.executable" else v.text if v.text is not None else v.hint for s in subjects for v in (s.items or (s,))]
        if kind == "shell" and len(parts) > 1 and re.search(r"(^|/)python[\d.]*(\.exe)?$", parts[0]):
            if parts[1] == "-c":
                self.nested(parts[2] if len(parts) > 2 else None, e)
            elif parts[1] == "-":
                subjects = [named.get("input", NOTHING)]
                self.nested(subjects[0].text, e)
        python = kind == "shell" and len(parts) > 1 and parts[0].endswith("python") and parts[1] in ("-c", "-")
        if kind == "code":
            self.nested(first.text, e)
        sus = self.hard([callee, *subjects]) or qn.startswith("__builtins__.")
        alias = kind == "code" and (qn.startswith("builtins.") or isinstance(e.func, ast.Name) and e.func.id != qn)
        stdin = python and parts[1] == "-"
        flags = (SUSPICIOUS if sus else 0) | (PYTHON if python and not stdin else 0) | (LEAST_HIGH if alias or python else 0) | (HARD_SUBJECT if self.hard(subjects) else 0)
        self.emit("exec", e, qn, "\0".join(p.replace("\0", " ") for p in parts), "code" if stdin else kind, callee.taints.union(*(s.taints for s in subjects)), number=flags)
        self.leak(kind, qn, subjects)

    def detect(self, e: ast.Call, qn: str | None, callee: Value, args: list[Value], named: dict, flow: frozenset) -> None:
        if qn is None:
            return
        first = args[0] if args else NOTHING
        target = named.get("target", NOTHING) if qn in C.INDIRECT_EXEC else first if qn == "map" else NOTHING
        if target.path in _SHELL | _CODE:
            self.emit("exec", e, target.path, None, "shell" if target.path in _SHELL else "code", target.taints, number=EXTRA | (SUSPICIOUS if self.hard([target]) else 0))
        elif qn in _SHELL or qn in _CODE:
            self.execution(e, qn, callee, args, named)
        if qn == "str" and first.path == "os.environ":
            self.emit("environment", e, first.path)
        if qn in C.ENV_CALLS:
            self.emit("env", e, first.text if first.text is not None else named.get("key", NOTHING).text)
        if qn in _SINKS or _URLLIB.match(qn):
            sent = [*args, *(v for k, v in named.items() if k not in C.IGNORED_EXFIL_KEYWORDS)]
            taints = frozenset().union(*(v.taints for v in sent)) if sent else frozenset()
            if taints:
                self.emit("exfil", e, qn, taints=taints)
            self.leak("exfil", qn, sent)
        if qn in _DOWNLOADS:
            texts = [v.text for v in [*args, *named.values()] if v.text]
            for t in texts[:1]:
                to = (args[1].text or args[1].hint) if len(args) > 1 else texts[1] if len(texts) > 1 else ""
                temporary = qn.endswith("urlretrieve") and any(m in to for m in C.TEMP_MARKS)
                self.emit("download", e, t, to, qn, flow, number=2 if temporary else 0)
        if qn in ("open", "io.open", "pathlib.Path.open") or qn in C.PATH_WRITES:
            mode = mode_of(args[1:2], named)
            name = first.text if qn not in C.PATH_WRITES else None
            if qn in C.PATH_WRITES:
                name = callee.hint
            elif qn == "pathlib.Path.open":
                name, mode = callee.hint, mode_of(args[0:1], named)
            if name and (qn in C.PATH_WRITES or set(mode) & set("wax+")):
                self.emit("write", e, name)
        if self.is_setup and qn in C.SETUP_CALLS and "cmdclass" in named:
            for k in next(k.value for k in e.keywords if k.arg == "cmdclass").values if isinstance(next(k.value for k in e.keywords if k.arg == "cmdclass"), ast.Dict) else []:
                if isinstance(k, ast.Name):
                    self.emit("cmdclass", e, k.id)


def _plain(text: str | None) -> str | None:
    """Text that can be written as UTF-8: lone surrogates become escapes."""
    return text if text is None or text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def guarded(walk: Walk) -> list[dict]:
    """The facts of a walk; if it fails, those found so far and an ``error`` fact."""
    try:
        found = walk.run()
    except RecursionError:
        walk.emit("error", (0, 0), "too deep")
        found = walk.facts
    except Exception as error:  # a file that cannot be analysed is a row, not the end of the job
        walk.emit("error", (0, 0), f"{type(error).__name__}: {error}"[:200])
        found = walk.facts
    for f in found:
        f["name"], f["text"] = _plain(f["name"]), _plain(f["text"])
    return found


def is_setup_name(path: str | None) -> bool:
    return (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower().endswith("setup.py")


def facts(source: str | None, path: str | None) -> list[dict]:
    """Facts of a source text; a null text has none.  Whatever goes wrong in a text is told by an ``error`` fact."""
    if source is None:
        return []
    try:
        walk = Walk(source, is_setup_name(path))
    except Exception as error:
        return [{"kind": "error", "ord": 0, "start": 0, "end": 0, "name": _plain(f"{type(error).__name__}: {error}"[:200]), "text": None, "how": "", "taints": [], "number": 0, "depth": 0}]
    return guarded(walk)
