"""What the facts of a file say of each other, as expressions over the array of them: no join, no shuffle, no Python.

Facts stand in the order in which the file's statements are run through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C

#: Kinds that make an install hook's class one that can do harm.
_ABLE = ["exec", "exfil", "download", "env"]


def spawns(facts: Column) -> Column:
    """Whether a shell command, or a terminal, is started anywhere in the file."""
    return F.exists(facts, lambda f: f["kind"].isin("call", "exec") & f["name"].isin([*C.SHELL_COMMANDS, "pty.spawn"]))


def of_kind(facts: Column, kind: str) -> Column:
    return F.filter(facts, lambda f: f["kind"] == kind)


def run_later(download: Column, downloads: Column, runs: Column) -> Column:
    """Whether what a download wrote is named by a command after it, and no other download wrote it anew in between."""
    path = download["text"]

    def names_it(run: Column) -> Column:
        anew = F.exists(downloads, lambda d: (d["text"] == path) & (d["ord"] > download["ord"]) & (d["ord"] < run["ord"]))
        return (run["ord"] > download["ord"]) & F.coalesce(F.contains(run["text"], path), F.lit(False)) & ~anew

    return (path != "") & F.exists(runs, names_it)


def able(hook: Column, facts: Column) -> Column:
    """Whether a class, an install hook, has within it anything that executes, sends, downloads or reads secrets."""
    return F.exists(facts, lambda f: f["kind"].isin(_ABLE) & (f["start"] >= hook["start"]) & (f["end"] <= hook["end"]))


def related(facts: Column) -> Column:
    """The facts with their numbers where others decide them.

    1 for a copied descriptor in a file that spawns a shell, and for a
    download that is run later; 2 for a hook whose class is able to do harm.
    No facts, and null, stay as they are.
    """

    def decided(every: Column) -> Column:
        def of(shell: Column) -> Column:
            downloads, runs = of_kind(every, "download"), of_kind(every, "exec")

            def number(f: Column) -> Column:
                return (
                    F.when((f["name"] == "os.dup2") & shell, F.lit(1))
                    .when((f["kind"] == "download") & F.coalesce(run_later(f, downloads, runs), F.lit(False)), F.lit(1))
                    .when((f["kind"] == "hook") & able(f, every), F.lit(2))
                    .otherwise(f["number"])
                )

            return F.transform(every, lambda f: F.struct(*[(number(f) if n == "number" else f[n]).alias(n) for n in ("kind", "ord", "start", "end", "name", "text", "how", "taints", "number", "depth")]))

        return _let(spawns(every), of)

    # most files have nothing that depends on others
    concerned = F.exists(facts, lambda f: (f["name"] == "os.dup2") | f["kind"].isin("download", "hook"))
    return F.when(concerned, _let(facts, decided)).otherwise(facts)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)
