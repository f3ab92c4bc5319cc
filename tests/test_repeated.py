"""Files of one text are analysed once, each call under limits of its own, and a fact meets the rules of its kind alone."""

import os
import time

import pyarrow as pa
import pytest

from larkspur.functions import catalogue as C
from larkspur.operators import limits, repeated, rules
from larkspur.operators.analysis import facts
from larkspur.operators.repeated import Repeated


def rows(texts, paths):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["n", "content", "file_path"])


def analysed(call, *batches, seconds=10.0):
    with limits.Limited(call, seconds) as limited:
        made = Repeated(limited, lambda answers: (rules.facts_array(answers),), [])
        out = pa.Table.from_batches(list(made.batches(iter(batches), 1, 2, ["facts"])))
        assert made.bytes <= repeated.REMEMBERED
        return out


def test_equal_texts_are_analysed_once_and_setup_files_apart(tmp_path):
    log = tmp_path / "calls"

    def call(text, path):
        with open(log, "a") as out:
            out.write("x")
        return facts(text, path)

    texts = ["from setuptools import setup\nsetup(cmdclass={'install': Run})\n", "x = 1\n", None, ""] * 300
    paths = [["a.py", "d/setup.py", None][i // 4 % 3] for i in range(len(texts))]
    got = analysed(call, rows(texts, paths), rows(texts, paths))
    assert len(log.read_text()) == 6  # three texts, as setup files and as others
    assert got.column("n").to_pylist() == [*range(len(texts))] * 2
    assert got.column("facts").to_pylist() == [facts(t, p) for t, p in zip(texts, paths)] * 2


@pytest.mark.parametrize("name,value", [("REMEMBERED", 4_000), ("LARGEST", 0), ("SENT", 1), ("BATCH", 1)])
def test_small_bounds_give_the_same(monkeypatch, name, value):
    texts = [f"import os\nos.system('{i % 70}')\n" for i in range(500)]
    monkeypatch.setattr(repeated, name, value)
    got = analysed(facts, rows(texts, ["a.py"] * 500))
    assert got.column("n").to_pylist() == [*range(500)]
    assert got.column("facts").to_pylist() == [facts(t, "a.py") for t in texts]


def test_what_failed_is_not_remembered():
    texts = ["a", "slow", "dies", "b", "bad", "c", "slow"]

    def call(text, path):
        if text == "slow":
            time.sleep(60)
        if text == "dies":
            os._exit(1)
        if text == "bad":
            raise ValueError("no")
        return []

    got = analysed(call, rows(texts, ["a.py"] * 7), rows(texts[1:2], ["a.py"]), seconds=0.5).column("facts").to_pylist()
    errors = [x[0]["name"] if x else None for x in got]
    slow, dead = "stopped after 0.5 s", "the process that did it ended"
    assert errors == [None, slow, dead, None, "ValueError: no", None, slow, slow]
    with limits.Limited(call, 0.5) as limited:
        assert [type(x).__name__ for x in limited.run_each([(t, None) for t in texts])] == ["list", "LimitReached", "CallFailed", "list", "CallFailed", "list", "LimitReached"]
        assert limited.run_each([]) == [] and limited.run("a", None) == []


def test_a_fact_meets_the_rules_of_its_kind_alone(spark):
    """Every branch gives its kind's findings in the catalogue's order, and none those of another kind."""
    name = f"{C.IDENTIFIERS[1][0]}_{C.IDENTIFIERS[0][0]}".upper()
    facts_ = [("call", "pty.spawn", None), ("def", name, None), ("called", name, None), ("param", name, None), ("target", name, None), ("import", "socket", None), ("import", name, None), ("comment", None, " ".join(m for m, _ in C.COMMENTS).upper()), ("part", name, None), (None, name, None)]
    schema = f"n int, f {rules.FACT}"
    table = spark.createDataFrame([(i, (kind, i, 0, 1, name_, text, "", [], 0, 0)) for i, (kind, name_, text) in enumerate(facts_)], schema)
    plan = table.select("n", rules.fact_findings(table["f"]).alias("x"))
    got = [[(x.rule, x.confidence, x.label) for x in r.x] for r in plan.orderBy("n").collect()]
    of = lambda rule, level, label: (rules.CODE[rule], level, label)
    level = C.IDENTIFIERS[0][1]
    assert got == [
        [of("SuspiciousCall", 4, "pty.spawn")],
        [of("SuspiciousFunctionName", level, name)],
        [of("SuspiciousFunctionName", level, name)],
        [of("SuspiciousParameterName", level, name)],
        [of("SuspiciousVariable", level, name)],
        [of("SocketImport", 2, "socket")],
        [],
        [of("SuspiciousComment", 5, m) for m, _ in C.COMMENTS],
        [],
        [],
    ]
    # one chain over the kind, so that a fact's other kinds cost it nothing: before, each rule asked for the kind by itself
    assert set(rules._by_kind(table["f"])) >= {"call", "literal", "exec", "import", "download", "exfil"}
