"""Features, models, reports, datasets, alerts and the command line on small sources."""

import base64
import gzip
import io
import json
import tarfile
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import __main__ as cli
from larkspur import api
from larkspur.functions import catalogue as C
from larkspur.operators import boosting, features, model
from larkspur.operators import rules as R
from larkspur.operators.analysis import facts
from larkspur.plans import catalog
from larkspur.sinks import report
from larkspur.sources import datasets
from larkspur.sources.scan import expand, scan
from larkspur.streaming import alerts

SOURCE = "import os\n\ndef f():\n    return 1\n\nos.system('ls')\nx = 1\ny = 2\nz = 3\n"


def sources(spark, rows):
    """(archive, path, text) as sources."""
    made = [(str(i), a, p, t, None) for i, (a, p, t) in enumerate(rows)]
    return spark.createDataFrame(made, "file_id string, archive_path string, file_path string, content string, error string")


# -- one hostile file -------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "error"),
    [("x = chr(0xd800)\n", None), ("x = '\\ud800' + 'y'\n", None), ("b'x'.decode('a\\0b')\n", None), ("import q\nx = q" + ".a()" * 200 + "\n", None), ("a = 'abcdefgh'\n" + "a = a + a\n" * 40, "texts too long to fold")],
)
def test_hostile_files_are_rows(spark, text, error):
    rows = R.audit(sources(spark, [(None, "bad.py", text), (None, "good.py", "import os\nos.system('ls')\n")])).collect()
    assert [r.rule for r in rows if r.file_path == "good.py"] == ["HX3010"]
    found = [f["name"] for f in facts(text + "import os\nos.system('ls')\n", "a.py") if f["kind"] in ("error", "exec")]
    assert "os.system" in found and (error is None or error in found)


def test_failures_of_the_walk_are_told(monkeypatch):
    monkeypatch.setattr("larkspur.operators.analysis.Walk.klass", lambda self, s: 1 / 0)
    found = facts("eval('1')\nclass A:\n    pass\n", "a.py")
    assert ("exec", "eval") in [(f["kind"], f["name"]) for f in found]
    assert any(f["kind"] == "error" and "ZeroDivisionError" in f["name"] for f in found)


def test_order_of_findings():
    kinds = [f["kind"] for f in facts("eval('1')\n# Pyarmor\n__import__('os')\n", "a.py") if f["kind"] in ("exec", "comment", "dynamic_import")]
    assert kinds == ["dynamic_import", "comment", "exec"]


# -- archives ---------------------------------------------------------------


def _zip(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x = 1\n")
    return out.getvalue()


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archive_limits_give_error_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ARCHIVE_ENTRIES", 3)
    from larkspur.sources.scan import members

    for name, few, many in (("a.zip", _zip(["1.py", "2.py", "3.py"]), _zip(["1.py", "2.py", "3.py", "4.py"])), ("a.tar.gz", _tar([("1.py", b""), ("2.py", b""), ("3.py", b"")]), _tar([(f"{i}.py", b"") for i in range(4)]))):
        assert [r[3] for r in members(name, few)] == [None] * 3
        assert [r[2:] for r in members(name, many)] == [(None, "TooMany: more than 3 entries")]
    large = spark.createDataFrame([("/x/big.zip", C.MAX_ARCHIVE_BYTES + 1, b"")], "path string, length long, content binary")
    assert [r.error for r in expand(large).collect()] == ["archive too large"]


def test_names_are_excluded_but_not_members(spark, tmp_path):
    (tmp_path / "skip.zip").write_bytes(_zip(["a.py"]))
    (tmp_path / "keep.zip").write_bytes(_zip(["skip.zip.py", "skip.py"]))
    (tmp_path / "skip.py").write_text("x = 1\n")
    (tmp_path / "latin.py").write_bytes("é = 1\n".encode("latin-1"))
    rows = scan(spark, str(tmp_path), ["skip.py", "skip.zip"]).collect()
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in rows) == ["latin.py", "skip.py", "skip.zip.py"]
    assert [r.error for r in rows if r.file_path.endswith("latin.py")] == ["not UTF-8"]
    assert scan(spark, str(tmp_path), ["skip.py", "skip.zip", "keep.zip", "latin.py"], empty_ok=True).count() == 0


def test_bad_entries_do_not_end_an_archive():
    from larkspur.sources.scan import members

    data = _tar([("1.py", b"x = 1\n"), ("2.py", "é".encode("latin-1")), ("3.py", b"y = 2\n")])
    assert [(r[1], r[2], r[3]) for r in members("a.tar.gz", data)] == [("1.py", "x = 1\n", None), ("2.py", None, "not UTF-8"), ("3.py", "y = 2\n", None)]
    cut = members("a.tar.gz", gzip.compress(gzip.decompress(data)[:1600]))
    assert [r[1] for r in cut][0] == "1.py"


# -- features and models ----------------------------------------------------


def test_features_of_every_rule(spark):
    row = features.features(sources(spark, [(None, "a.py", SOURCE), (None, "b.py", None), (None, "c.py", "")])).withColumn("keys", F.map_keys("features")).orderBy("file_id").collect()
    one, none, empty = (r.features for r in row)
    assert row[0]["keys"] == sorted(one) and one["meta.feature_count"] == len(one) - 1
    assert one["rule.count.HX3010"] == 1 and one["rule.conf_sum.HX3010"] == 3 and all(f"rule.count.{code}" in none for code, *_ in C.RULES)
    assert none["rule.total_hits"] == 0 and "source.num_lines" not in none and empty["source.num_lines"] == 0


def test_repaired_texts_have_features(spark):
    row = features.features(sources(spark, [(None, "a.py", "print 'x'\nif x:\n    eval(y)\nelif z:\n    pass\n")])).first()
    assert row.features["ast.num_calls"] == 2 and row.features["stmt.If"] == 1


def test_vocabulary_and_dense(spark):
    rows = spark.createDataFrame([("b", {"y": 1.0, "x": 2.0}), ("a", {"z": 3.0})], "file_id string, features map<string,double>")
    names = [r.name for r in features.vocabulary(rows).orderBy("index").collect()]
    assert names == ["z", "x", "y"]
    assert [list(r.vector) for r in features.dense(rows, names).orderBy("file_id").collect()] == [[3.0, 0.0, 0.0], [0.0, 2.0, 1.0]]


def test_model_by_records_and_vectors():
    m = model.TreeModel.load(gzip.compress(json.dumps(catalog.MODEL).encode()))
    x = np.array([[0, 0], [1, 0], [2, 1], [np.nan, 5]], np.float32)
    by_vector = m.raw_of_vectors(x)
    assert by_vector.tolist() == [-1.375, 0.125, 3.125, -0.125]
    assert m.raw_of_records([{"rule.total_hits": 2.0, "ast.num_calls": 1.0}, {}, None]).tolist() == [3.125, -1.375, -1.375]
    with pytest.raises(ValueError):
        m.raw_of_vectors(np.zeros((1, 3)))
    spec = json.loads(json.dumps(catalog.MODEL))
    spec["features_info"]["float_features"][0] |= {"has_nans": True, "nan_value_treatment": "AsTrue"}
    assert model.TreeModel(spec).raw_of_vectors(x)[3] == 2.0 + 1.0 + 0.125


def test_training_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 2] > 1).astype(float)
    rows = [({"a": float(r[0]), "b": float(r[1]), "c": float(r[2])}, int(v)) for r, v in zip(x, y)]
    got = boosting.train(spark.createDataFrame(rows, "features map<string,double>, label int"), iterations=12, depth=3, rate=0.5, l2=1.0, folds=3)
    assert ((got.model.raw_of_records([r for r, _ in rows]) > 0) == (y > 0)).mean() > 0.93 and min(got.precision) > 0.8


# -- reports ----------------------------------------------------------------


def test_preview_and_diagnostic():
    at = SOURCE.index("os.system")
    got = report.preview("a.py", "p.zip", "HX3010", 3, SOURCE, at, at + 15)
    assert got.splitlines()[0] == f"p.zip:a.py:{at}-{at + 15} [HX3010 Medium]"
    assert [line[0] for line in got.splitlines()[1:]].count(">") == 1 and ">    6 | os.system('ls')" in got
    text = report.diagnostic("a.py", None, "é = 1\neval(x)\n", [(7, 14, "HX3000")], "runs code", "HX3000", ["Confidence: High"])
    assert "warning[HX3000]: runs code" in text and "a.py:2:1" in text and "^^^^^^^ HX3000" in text and "= Confidence: High" in text


def test_json_and_dicts(spark):
    results = api.file_results(sources(spark, [("p.zip", "a.py", SOURCE), (None, "b.py", "x = 1\n")]))
    lines = [json.loads(r.value) for r in report.json_lines(results, annotate=True).collect()]
    assert [(x["path"], x["archive_path"], x["rule"], x["confidence"], x["location_start"]) for x in lines] == [("a.py", "p.zip", "HX3010", "medium", SOURCE.index("os.system"))]
    assert ">    6 | os.system" in lines[0]["annotation"]
    plain = [json.loads(r.value) for r in report.json_lines(api.file_results(sources(spark, [(None, "a.py", SOURCE)]))).collect()]
    assert "archive_path" not in plain[0] and "annotation" not in plain[0]
    dicts = {d["path"]: d for d in api.to_dicts(results)}
    assert dicts["b.py"]["items"] == [] and dicts["a.py"]["items"][0]["location"] == {"start": SOURCE.index("os.system"), "end": SOURCE.index("os.system") + 15}
    dumped = report.annotated_files(results).collect()
    assert len(dumped) == 1 and dumped[0].name.startswith("audit_") and "HX3010" in dumped[0].text


def test_filters_and_levels():
    assert [api.level(x) for x in ("LOW", "med", "mid", "VeryHigh", "very_high")] == [2, 3, 3, 5, 5]
    assert api.unknown_codes(["HX3010", "HX0000"]) == ["HX0000"]
    with pytest.raises(ValueError):
        api.level("certain")


def test_benchmark(spark):
    src = sources(spark, [("p.zip", "a.py", SOURCE), ("q.zip", "b.py", "x = 1\n"), (None, "c.py", "eval('1')\nimport pickle\n")])
    counts = report.benchmark(api.file_results(src), src)
    assert (counts["total_files"], counts["total_matches"]) == (3, 3)
    assert counts["confidence"] == [(3, 2), (2, 1)] and dict(counts["rules"]) == {"HX3010": 1, "HX3000": 1, "HX5030": 1}
    text = "\n".join(report.benchmark_text("x", counts, 1.0, print_missing=True))
    assert "Missing audits for: q.zip" in text and "ShellExec (HX3010): 1" in text


# -- datasets ---------------------------------------------------------------


@pytest.fixture
def dataset(tmp_path):
    code = lambda t: base64.b64encode(t.encode()).decode()
    rows = [
        {"code": code(SOURCE), "verdict": "malicious", "file": "a.py", "other": 1},
        {"code": code("x = 1\n"), "verdict": "malicious", "file": "b.py"},
        {"code": code(SOURCE), "verdict": "benign", "file": "c.py"},
        {"code": "not base64", "verdict": "malicious", "file": "d.py"},
        {"code": base64.b64encode(b"\xff\xfe").decode(), "verdict": "malicious", "file": "e.py"},
    ]
    path = tmp_path / "data.jsonl.gz"
    path.write_bytes(gzip.compress(("\n".join(map(json.dumps, rows)) + "\nnot json\n").encode()))
    return str(path)


def test_dataset(spark, dataset):
    entries = datasets.read(spark, dataset)
    errors = {r.file: r.error for r in datasets.decoded(entries).collect()}
    assert errors == {"a.py": None, "b.py": None, "c.py": None, "d.py": "code is not base64", "e.py": "code is not UTF-8", None: "line not read"}
    assert datasets.code_of(entries, "a.py").first()[0] == SOURCE and datasets.code_of(entries, "x.py").count() == 0
    rows = {r["file"]: r for r in (json.loads(x.value) for x in datasets.validation(entries).collect())}
    assert set(rows) == {"a.py", "b.py"} and rows["a.py"]["rules"][0]["code"] == "HX3010" and "code" not in rows["a.py"]
    assert [json.loads(x.value)["file"] for x in datasets.validation(entries, no_rules=True, with_code=True).collect()] == ["b.py"]
    lines = [json.loads(x.value) for x in datasets.feature_lines(entries, limit=2).collect()]
    assert [(x["_file_path"], x["_label"]) for x in lines] == [("a.py", "malicious"), ("b.py", "malicious")] and lines[0]["rule.total_hits"] == 1


def test_packages_and_feeds(spark):
    now = F.lit(datetime(2024, 5, 10)).cast("timestamp")
    packages = spark.createDataFrame([("a", "p/a", datetime(2024, 5, 9), "source"), ("b", "p/b", datetime(2024, 5, 1), "source"), ("c", "p/c", datetime(2024, 5, 9), "cp312")], "name string, path string, upload_time timestamp, python_version string")
    assert [r.name for r in datasets.recent_packages(packages, 3, now).collect()] == ["a"]

    def fetch(path):
        if path == "p/b":
            raise OSError("gone")
        return path.encode()

    got = {r.name: (r.content, r.error) for r in datasets.downloads(packages, spark.createDataFrame([("p/c",)], "path string"), fetch).collect()}
    assert bytes(got["a"][0]) == b"p/a" and got["b"] == (None, "OSError: gone") and set(got) == {"a", "b"}
    xml = "<rss><channel><item><title>left pad 1.0</title><link>l1</link><pubDate>d1</pubDate></item><item><title>bad</title><link>l2</link><pubDate>d2</pubDate></item></channel></rss>"
    assert [tuple(r) for r in datasets.feed_entries(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("left pad", "1.0", "l1", "d1")]
    answer = json.dumps({"urls": [{"packagetype": "bdist_wheel", "url": "w"}, {"packagetype": "sdist", "url": "s"}]})
    assert [r[0] for r in spark.createDataFrame([(answer,), ("{}",)], "a string").select(datasets.sdist_url(F.col("a"))).collect()] == ["s", None]
    files = spark.createDataFrame([(f"f{i}", i // 2) for i in range(10)], "name string, mtime long")
    assert sorted(r.name for r in datasets.over_quota(files, 4).collect()) == [f"f{i}" for i in range(6)]
    dump = datasets.package_dump(sources(spark, [("p.zip", "x/a.py", "1\n"), ("p.zip", "b.py", "2\n"), (None, "x/c.py", "3\n")]), "x/").collect()
    assert [(r.file_path, "1\n" in r.value) for r in dump] == [("x/a.py", True)]


# -- alerts -----------------------------------------------------------------

ITEM = "struct<rule:string,confidence:string,label:string,description:string,annotation:string>"
RESULT = f"package_name string, version string, link string, package_file string, file_path string, archive_path string, score double, items array<{ITEM}>"


def _result(package, path, score, items, version="1"):
    return (package, version, "l", "f.tar.gz", path, "f.tar.gz", score, items)


TOP = ("HX4010", "very_high", "exec", "text", "note")
RESULTS = [
    _result("a", "a.py", 0.9, [TOP, TOP, ("HX1000", "low", "x", "low text", None)]),
    _result("a", "tests/b.py", 0.9, [TOP]),
    _result("b", "b.py", 0.3, [TOP]),
    _result("c", "c.py", 0.5, [TOP] + [("HX1000", "low", "x", f"t{i}", None) for i in range(6)]),
    _result("d", "d.py", 0.75, [("HX1000", "low", "x", f"t{i}", None) for i in range(7)]),
]


def test_alert_decisions(spark):
    rows = spark.createDataFrame(RESULTS, RESULT)
    got = {r.package_name: (r.files, r.excluded, r.high_scores, r.top_findings, r.alert) for r in alerts.packages(rows).collect()}
    assert got == {"a": (2, 1, 1, 2, True), "b": (1, 0, 0, 0, False), "c": (1, 0, 0, 1, True), "d": (1, 0, 1, 0, True)}
    messages = {(r.package_name, r.block): r.message for r in alerts.messages(rows).collect()}
    assert set(messages) == {("a", "note"), ("a", "__score__"), ("c", "note"), ("d", "__score__")}
    assert messages["a", "note"].count("HX4010 (very_high)") == 1 and "Very-high findings: 2" in messages["a", "note"]
    assert "... and 2 more findings" in messages["d", "__score__"] and "(ML score: 0.7500)" in messages["d", "__score__"]
    long = spark.createDataFrame([_result("z", "z.py", 0.9, [("HX1000", "very_high", "x", "d", "n" * 9000)])], RESULT)
    assert all(len(r.message) <= alerts.MESSAGE_CHARS for r in alerts.messages(long).collect())


def test_monitor_alerts_once(spark, tmp_path):
    rows = spark.createDataFrame(RESULTS, RESULT)
    rows.write.parquet(str(tmp_path / "in"))
    told = []
    run = lambda: alerts.monitor(spark, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "sent"), str(tmp_path / "state"), lambda new: told.extend(r.package_name for r in new.collect()), once=True).awaitTermination(120)
    run()
    assert sorted(told) == ["a", "a", "c", "d"]
    spark.createDataFrame([_result("a", "a.py", 0.9, [TOP], "2")], RESULT).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(told) == ["a", "a", "c", "d"]


def test_first_entry_of_a_dataset_in_its_order(spark, tmp_path):
    entry = lambda archive, text: json.dumps({"archive": archive, "file": "same.py", "code": base64.b64encode(text.encode()).decode(), "verdict": "benign"})
    (tmp_path / "d.jsonl").write_text("\n".join(entry(f"z{9999 - i}", f"x = {i}\n") for i in range(5000)) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "50000")
    try:
        entries = datasets.read(spark, str(tmp_path / "d.jsonl"))
        assert entries.rdd.getNumPartitions() > 3
        assert [r.content for r in datasets.code_of(entries, "same.py").collect()] == ["x = 0\n"]
    finally:
        spark.conf.unset(name)


# -- command line -----------------------------------------------------------


def test_command_line(spark, tmp_path, dataset):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(SOURCE)
    (tmp_path / "src/p.zip").write_bytes(_zip(["in.py"]))
    run = lambda *args: list(cli.run(spark, cli.parser().parse_args(args)))
    assert run("rules")[0].count("| HX") == 40
    assert "warning[HX3010]" in "".join(run("audit", str(tmp_path / "src")))
    assert [json.loads(x)["rule"] for x in run("audit", str(tmp_path / "src"), "--output-format", "json", "--annotate")] == ["HX3010"]
    assert run("audit", str(tmp_path / "src"), "--exclude", "HX3010") == [] and run("audit", str(tmp_path / "src"), "--min-confidence", "high") == []
    run("audit", str(tmp_path / "src"), "--dump", str(tmp_path / "dump"), "--output", str(tmp_path / "out.txt"))
    assert "HX3010" in (tmp_path / "out.txt").read_text() and spark.read.text(str(tmp_path / "dump")).count() > 0
    assert any("Total files: 2" in x for x in run("benchmark", str(tmp_path / "src"), "--missing"))
    assert "in.py" in "".join(run("dump-package", str(tmp_path / "src")))
    run("dataset", "generate-features", dataset, str(tmp_path / "features"))
    assert spark.read.text(str(tmp_path / "features")).count() == 3
    assert len(run("dataset", "validate", dataset)) == 2 and run("dataset", "read-file", dataset, "b.py") == ["x = 1\n"]
    (tmp_path / "model.json").write_text(json.dumps(catalog.MODEL))
    assert "score for file: 0.84" in "".join(run("audit", str(tmp_path / "src"), "--model", str(tmp_path / "model.json"), "--min-score", "0.3"))
