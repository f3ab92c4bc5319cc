"""Functions for SQL: ``register`` gives a session table functions over source texts and scalar functions over tokens.

``SELECT s.id, f.* FROM src s, LATERAL code_facts(s.content) f`` gives the facts
that the rules look at, ``LATERAL code_features(s.content)`` the counts of a
text.  The rules themselves are Catalyst expressions: ``rules.findings``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larkspur.functions.patterns import marked
from larkspur.operators.limits import SECONDS, CallFailed, Limited, LimitReached

FACTS = "kind string, ord int, start int, end int, name string, text string, how string, taints array<string>, number int, depth int"
_FIELDS = [f.split()[0] for f in FACTS.split(", ")]


def _facts(text: str, path: str) -> list[dict]:
    from larkspur.operators.analysis import facts

    return marked(facts(text, path))


def _counts(text: str, path: str) -> dict[str, float]:
    from larkspur.operators.features import facts_and_counts

    return facts_and_counts(text, path)[1]


class _Limited:
    """One child process for each task; a text that reaches the limits gives one row that says so."""

    call = staticmethod(_facts)

    def __init__(self):
        self.limited = Limited(type(self).call, SECONDS)

    def asked(self, text: str | None, path: str | None):
        if text is None:
            return None, None
        try:
            return self.limited.run(text, path or "a.py"), None
        except (LimitReached, CallFailed) as error:
            return None, str(error)[:200]

    def terminate(self) -> Iterator[tuple]:
        self.limited.__exit__()
        return iter(())


class CodeFacts(_Limited):
    def eval(self, content: str, path: str = "a.py") -> Iterator[tuple]:
        found, error = self.asked(content, path)
        if error:
            yield ("error", 0, 0, 0, error, None, "", [], 0, 0)
        for fact in found or []:
            yield tuple(fact[name] for name in _FIELDS)


class CodeFeatures(_Limited):
    call = staticmethod(_counts)

    def eval(self, content: str, path: str = "a.py") -> Iterator[tuple]:
        found, error = self.asked(content, path)
        if error:
            yield (f"error: {error}", None)
        yield from sorted((found or {}).items())


def register(spark: SparkSession) -> None:
    """Registers ``code_facts(content [, path])`` and ``code_features(content [, path])`` as table functions of the session; a null text gives no rows."""
    spark.udtf.register("code_facts", udtf(CodeFacts, returnType=FACTS))
    spark.udtf.register("code_features", udtf(CodeFeatures, returnType="name string, value double"))
