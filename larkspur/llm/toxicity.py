"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reported speech) and
each clause's classes run through the composition of small transducers: one
notes a target, one a negation, one reported speech, one emits a match at an
insult or a threat.  A match weighs what its path does: more with a target,
less when negated or reported.  A document's features are sums over its
matched clauses, and a logistic model of a few weights turns them into a score
from 0 to 1.

The fixed word lists are English.  Insults of any language are learned as
words and word stems from labelled rows: a form is taken where its documents
are labelled toxic far beyond chance, with all forms tried allowed for.  At
most ``TRAIN_ROWS`` labelled rows are used, by hash order of their ids.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._learn import Logistic
from larkspur.llm._spark import cut, table
from larkspur.llm._text import ALNUM, Words, as_bytes, chunks

TRAIN_ROWS, ROUNDS, CUT = 12_000, 3, 0.3
STEMS = range(3, 10)

# Word classes of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown vermin imbecile fool bastard filth".split()
THREATS = "kill hurt destroy beat burn shoot stab crush punish hang".split()
TARGETS = "you your yourself he she they him her them these those that this people".split()
NEGATIONS = "not no never nor isn aren wasn don doesn nobody without hardly".split()
REPORTS = "said says say wrote called quoted claimed reported told according allegedly".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Classes so many words apart do not act on each other.
REACH = 8


@dataclass(frozen=True)
class Transducer:
    """Transitions (state, class) -> (state, weight, output); absent ones keep the state and emit nothing."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, 0.0, ""))


TARGETED = Transducer({("", TARGET): ("t", 0.0, ""), ("t", INSULT): ("t", 0.7, "targeted"), ("t", THREAT): ("t", 1.5, "targeted")})
NEGATED = Transducer({("", NEGATION): ("n", 0.0, ""), ("n", INSULT): ("", -1.5, "negated"), ("n", THREAT): ("", -1.5, "negated")})
REPORTED = Transducer({("", REPORT): ("r", 0.0, ""), ("r", INSULT): ("r", -0.7, "reported"), ("r", THREAT): ("r", -0.7, "reported")})
ACTS = Transducer({("", INSULT): ("", 1.0, "insult"), ("", THREAT): ("", -1.0, "threat")})


def compose(machines: tuple[Transducer, ...]) -> tuple[tuple, dict]:
    """Start state and transitions of the machines run side by side: weights add up, outputs are joined."""
    start = ("",) * len(machines)
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        for symbol in range(6):
            if (state, symbol) in arcs:
                continue
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            to = tuple(s[0] for s in steps)
            acts = bool(steps[-1][2])
            arcs[state, symbol] = (to, math.exp(sum(s[1] for s in steps)) if acts else 0.0, " ".join(s[2] for s in steps if s[2]) if acts else "")
            todo.append(to)
    return start, arcs


START, ARCS = compose((TARGETED, NEGATED, REPORTED, ACTS))
N_FEATURES = 5


def matches(classes: list[int], places: list[int]) -> list[tuple[float, str]]:
    """Weight and kind of the matches in one clause's classes, which stand at ``places``."""
    state, out, before = START, [], None
    for symbol, at in zip(classes, places):
        if before is not None and at - before > REACH:
            state = START
        state, weight, kind = ARCS[state, symbol]
        if kind:
            out.append((weight, kind))
        before = at
    return out


class Lexicon:
    """Classes of words by hash; insults also by stem."""

    def __init__(self, words: list[str], stems: list[str]):
        entries = [(w, INSULT) for w in [*INSULTS, *words]]
        for names, kind in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            entries += [(w, kind) for w in names]
        self.keys, self.kinds = self._sorted(dict(entries))
        self.stems = {}
        for k in sorted({len(s.encode()) for s in stems}):
            self.stems[k] = self._sorted({s: INSULT for s in stems if len(s.encode()) == k})[0]

    @staticmethod
    def _sorted(entries: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.array([Words([w.encode()], ALNUM, lower=True).hashes()[0] for w in entries], np.uint64)
        order = np.argsort(hashes)
        return hashes[order], np.array(list(entries.values()), np.int8)[order]

    def classify(self, words: Words) -> np.ndarray:
        def found(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            return np.where(keys[at] == hashes, at, -1)

        if not len(words):
            return np.zeros(0, np.int8)
        hit = found(words.hashes(), self.keys)
        out = np.where(hit >= 0, self.kinds[hit], OTHER).astype(np.int8)
        size = words.end - words.start
        for k, keys in self.stems.items():
            long = np.flatnonzero(size >= k)
            out[long[found(words.prefix_hashes(long, k), keys) >= 0]] = INSULT
        return out


def features(texts: list[bytes | None], lexicon: Lexicon) -> tuple[np.ndarray, list[list[tuple[float, str]]]]:
    """A row of numbers for each text, and its matches."""
    words = Words(texts, ALNUM, lower=True)
    kinds = lexicon.classify(words)
    is_stop = np.isin(words.data, np.frombuffer(b".!?;:\n", np.uint8))
    at = np.flatnonzero(kinds != OTHER)
    clause = np.cumsum(is_stop)[words.start[at]]
    doc = words.doc[at]
    acts = np.flatnonzero((kinds[at] == INSULT) | (kinds[at] == THREAT))
    out: list[list[tuple[float, str]]] = [[] for _ in texts]
    numbers = np.zeros((len(texts), N_FEATURES))
    turn = np.ones(len(at) + 1, bool)
    turn[1:-1] = (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(turn)
    for c in np.unique(np.searchsorted(begin, acts, side="right") - 1).tolist():
        lo, hi = begin[c], begin[c + 1]
        d = int(doc[lo])
        got = matches(kinds[at[lo:hi]].tolist(), at[lo:hi].tolist())
        out[d] += got
        if got:
            numbers[d, 4] += 1
    for d, got in enumerate(out):
        insult = [w for w, kind in got if "insult" in kind]
        threat = [w for w, kind in got if "threat" in kind]
        numbers[d, 0], numbers[d, 1] = math.log1p(sum(insult)), math.log1p(sum(threat))
        numbers[d, 2] = max(insult, default=0.0) > 0.5
        numbers[d, 3] = 100 * sum(insult) / (20 + words.counts[d])
    numbers[:, 3] = np.log1p(numbers[:, 3])
    numbers[:, 4] = np.log1p(numbers[:, 4])
    return numbers, out


def _forms(text: str) -> set[str]:
    """Words and (marked by a dash) stems of a text."""
    words = {w for w in Words.split(text) if 3 <= len(w) <= 40 and not w.isdigit()}
    return words | {f"{w[:k]}-" for w in words for k in STEMS if len(w) > k}


def _count_forms(among: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in chunks(batches):
            for text in batch.column(0).to_pylist():
                forms = _forms(text or "")
                n.update(forms if among is None else forms & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["form", "n"])

    return run


def _unmatched(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(as_bytes(batch.column(0)), ALNUM, lower=True)
            hit = np.bincount(words.doc[lexicon.classify(words) == INSULT], minlength=batch.num_rows)
            yield batch.filter(pa.array(hit == 0))

    return run


def _chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Words and stems far commoner in toxic texts than chance allows; the longest of equal ones."""
    base, bar = n_toxic / max(n_toxic + n_clean, 1), 2 * math.log(max(len(toxic), 2)) + 8
    kept = {}
    for form, t in toxic.items():
        c = clean.get(form, 0)
        share = t / (t + c)
        gain = 2 * (t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0)) if base < 1 else 0
        if gain > bar and share > base and (t + 0.5) / (n_toxic + 1) >= 40 * (c + 0.5) / (n_clean + 1):
            kept[form] = t
    longest = {f for f, t in kept.items() if not (f.endswith("-") and any(kept.get(g, 0) >= 0.95 * t for g in kept if len(g.rstrip("-")) > len(f) - 1 and g.startswith(f[:-1]) and g != f))}
    return sorted(f for f in longest if not f.endswith("-")), sorted(f[:-1] for f in longest if f.endswith("-"))


@dataclass
class Model:
    lexicon: Lexicon
    weights: Logistic


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns insults and weights from at most ``rows`` rows of ``labels`` (doc_id, toxic, ...)."""
    held = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    held = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(held), "doc_id").select("text", "toxic"))  # at most ``rows`` ids

    def counted(part: DataFrame, among: set[str] | None, least: int) -> dict[str, int]:
        forms = part.select("text").mapInArrow(_count_forms(among), "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
        return {r[0]: r[1] for r in forms.where(F.col("n") >= least).collect()}

    words, stems, open_ = [], [], sample
    for _ in range(ROUNDS):  # each looks at the rows that the forms found so far leave without a match
        open_ = open_.mapInArrow(_unmatched(Lexicon(words, stems)), "text string, toxic int")
        open_ = cut(open_)
        sizes = dict(open_.groupBy("toxic").count().collect())
        n_clean, n_toxic = sizes.get(0, 0), sum(n for k, n in sizes.items() if k != 0)
        toxic = counted(open_.where("toxic <> 0"), None, max(4, n_toxic // 200))
        clean = counted(open_.where("toxic = 0"), set(toxic), 1) if toxic else {}
        more = _chosen(toxic, clean, n_toxic, n_clean)
        if not any(more):
            break
        words, stems = words + more[0], stems + more[1]
    lexicon = Lexicon(words, stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x, _ = features(as_bytes(batch.column(0)), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    x, y = np.array([r[0] for r in got]).reshape(-1, N_FEATURES), np.array([r[1] for r in got], float)
    # two made-up rows keep the model sensible where labels are few or of one kind
    x = np.vstack([x, np.zeros(N_FEATURES), [1.0, 0, 1, 1, 1]])
    return Model(lexicon, Logistic.fit(x, np.append(y, [0, 1]), penalty=1e-3))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score from 0 to 1, and the matched kinds with their numbers, for every row of ``docs``.

    Null, empty and wordless texts have no matches and get the score of none.
    Rows with null or repeated ids are scored like all others.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x, got = features(as_bytes(batch.column(1)), model.lexicon)
            kinds = [list(Counter(kind for _, kind in m).items()) for m in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.weights(x)), pa.array(kinds, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, matches map<string,bigint>")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; labels of held-out ids are not used."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
