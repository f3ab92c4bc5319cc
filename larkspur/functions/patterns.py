"""All literal patterns at once: one automaton, built once a process, one pass over a literal."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick

from larkspur.functions import catalogue as C

#: A mark holds two places in the table, each one more than the index and 0 for none.
SPAN = 1000


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, (pattern, *_) in reversed(list(enumerate(C.LITERAL_PATTERNS))):  # of equal patterns the first stays
        out.add_word(pattern, i)
    out.make_automaton()
    return out


@cache
def _statements() -> frozenset[int]:
    return frozenset(i for i, (pattern, *_) in enumerate(C.LITERAL_PATTERNS) if re.match("(import|from) ", pattern))


def mark(text: str | None) -> int:
    """The first pattern that a literal holds, and the first that is no import statement, as ``first + SPAN * other``.

    A literal of a length that no pattern is looked for in holds none.
    """
    if text is None or not C.LITERAL_BYTES[0] <= len(text.encode("utf-8", "replace")) <= C.LITERAL_BYTES[1]:
        return 0
    found = {i for _, i in _automaton().iter(re.sub(r"\\{1,2}", "/", text))}
    first = lambda held: min(held, default=-1) + 1
    return first(found) + SPAN * first(found - _statements())


def marked(facts: list[dict]) -> list[dict]:
    """Facts with the marks of the literals among them as their numbers."""
    for fact in facts:
        if fact["kind"] == "literal":
            fact["number"] = mark(fact["text"])
    return facts
