"""Files that would not end, rules of one's own, and what facts say of each other."""

import time

import pytest
from pyspark.sql import functions as F

from larkspur import api
from larkspur.functions import catalogue as C
from larkspur.functions import patterns
from larkspur.operators import analysis, features, limits, rules
from larkspur.operators.analysis import facts

SOURCE = "file_id string, archive_path string, file_path string, content string, error string"
GOOD = "import os\nos.system('ls')\n"
NESTED = "t = '" + "ab" * 500 + "'\nx = [[[[a + b + c + d for a in t] for b in t] for c in t] for d in t]\n"
DOUBLED = "x = 'abcdefgh' * 1000\ny = 'abcdefgh'\n" + "y += y\n" * 60
LISTS = "x = [1, 2, 3, 4]\n" + "x = x + x\n" * 60


def test_budgets_are_asked_before_the_work():
    for text, error in ((NESTED, "too many elements to evaluate"), (DOUBLED, "texts too long to fold"), (LISTS, "too many elements to evaluate")):
        began = time.time()
        found = facts(text + GOOD, "a.py")
        assert time.time() - began < 50
        assert [f["name"] for f in found if f["kind"] == "error"] == [error]
        assert [f["name"] for f in found if f["kind"] == "exec"] == ["os.system"]


def sources(spark, texts):
    return spark.createDataFrame([(str(i), None, "a.py", t, None) for i, t in enumerate(texts)], SOURCE).coalesce(1)


@pytest.mark.parametrize("analyse", [rules.with_facts, features.with_counts])
def test_files_that_would_not_end_are_errors_and_the_job_goes_on(spark, monkeypatch, analyse):
    # without budgets, the deadline is the net below
    for name in ("MAX_ELEMENTS", "MAX_FOLDED"):
        monkeypatch.setattr(analysis, name, 1 << 60)
    whole = lambda text, path: analysis.facts(text, path)
    with limits.Limited(whole, seconds=3, bytes_=1 << 30) as limited:
        for text in (NESTED, LISTS):
            began = time.time()
            found = rules.within(limited, text, "a.py")
            assert time.time() - began < 20 and found[-1]["kind"] == "error", found[-1]
        assert any(f["kind"] == "exec" for f in rules.within(limited, GOOD, "a.py"))
    rows = analyse(sources(spark, ["x = " + "+".join(["1"] * 50_000) + "\n", GOOD, None, ""]), seconds=0.02).orderBy("file_id").collect()
    assert [f.name for f in rows[0].facts] == ["stopped after 0.02 s"]
    assert rows[2].facts == [] and all(f.kind != "error" for f in rows[3].facts)


def test_a_child_that_dies_is_replaced():
    import os

    with limits.Limited(lambda x: os._exit(1) if x else "well", seconds=10) as limited:
        with pytest.raises(limits.CallFailed):
            limited.run(True)
        assert limited.run(False) == "well"
    with limits.Limited(lambda: [0] * (1 << 40), seconds=10) as limited:
        with pytest.raises(limits.CallFailed, match="memory"):
            limited.run()
    with limits.Limited(lambda: 1 // 0) as limited:
        with pytest.raises(limits.CallFailed, match="ZeroDivisionError"):
            limited.run()


def test_marks_against_every_pattern_in_turn():
    texts = [f"see {p} and {q}" for (p, *_), (q, *_) in zip(C.LITERAL_PATTERNS, reversed(C.LITERAL_PATTERNS))] + ["short", "x" * 600, "nothing of the kind", "a\\\\b\\c/d" * 3, "é" * 300]
    for text in texts:
        held = [i for i, (p, *_) in enumerate(C.LITERAL_PATTERNS) if p in text.replace("\\\\", "/").replace("\\", "/")] if 8 <= len(text.encode()) <= 512 else []
        plain = [i for i in held if not C.LITERAL_PATTERNS[i][0].startswith(("import ", "from "))]
        assert patterns.mark(text) == (min(held) + 1 if held else 0) + patterns.SPAN * (min(plain) + 1 if plain else 0)
    assert patterns.mark(None) == 0


def test_rules_of_ones_own(spark):
    rule = rules.Rule("ORG1", "Calls of eval, whatever for.", lambda f: ((f["kind"] == "exec") & f["name"].isin("eval", "builtins.eval"), F.when(F.size(f["taints"]) > 0, 9).otherwise(2), f["name"]))
    rows = sources(spark, ["eval('1')\n", GOOD])
    got = api.file_results(rows, extra=[rule]).orderBy("file_id").collect()
    assert [[(f.rule, f.confidence, f.description) for f in r.findings if f.rule == "ORG1"] for r in got] == [[("ORG1", 2, "Calls of eval, whatever for.")], []]
    assert [r.rule for r in rules.audit(rows, [rule]).where("rule = 'ORG1'").collect()] == ["ORG1"]
    assert {r.rule for r in rules.audit(rows, [rule]).collect()} - {"ORG1"} == {r.rule for r in rules.audit(rows).collect()}
    for code in ("HX3010", "", "1x"):
        with pytest.raises(ValueError):
            rules.Rule(code, "", rule.finds)
    with pytest.raises(ValueError):
        rules.audit(rows, [rule, rule])
    with pytest.raises(ValueError):
        api.file_results(rows, scorer=object(), extra=[rule])


def test_table_functions(spark):
    from larkspur import sql

    sql.register(spark)
    sources(spark, [GOOD, None, "x = ('a' + 'b')\n"]).createOrReplaceTempView("src")
    got = spark.sql("SELECT s.file_id, f.kind, f.name, f.text, f.how FROM src s, LATERAL code_facts(s.content) f WHERE f.kind IN ('exec', 'literal')").collect()
    assert sorted(map(tuple, got), key=str) == [("0", "exec", "os.system", "ls", "shell"), ("0", "literal", None, "ls", ""), ("2", "literal", None, "ab", "Concat")]
    counted = spark.sql("SELECT s.file_id, f.value FROM src s, LATERAL code_features(s.content, 'a.py') f WHERE f.name = 'ast.num_calls' ORDER BY 1").collect()
    assert [tuple(r) for r in counted] == [("0", 1.0), ("2", 0.0)]
