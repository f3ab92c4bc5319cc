"""Fingerprints, ranked search and source divergence against plain Python, on whole tables, odd rows and empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import divergence, fingerprints, impact_index, queries

Q = queries.queries()
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, hash string, score double, shard long, edge boolean"
LONG = " ".join(f"word{i % 9973}x" for i in range(200_000))
ROWS = [
    (7, None, "en", "a"), (6, "", "en", "a"), (5, " \t\n ", None, None), (4, "one two three", "en", "a"), (4, "one two three", "en", "a"),
    (4, "One TWO four", "en", "b"), (None, "no id here at all, of any kind", "en", "b"), (None, "no id here at all, of any kind", "en", "b"),
    (3, LONG, "en", "a"), (2, LONG + " tail", "de", "a"), (1, "ünïcode — 漢字 x1 ÀÉ two", "de", "b"), (0, "x" * 5000, "de", "c"), (-3, "a a a a a a a a a a a a a a a a a a a a a a a a", "fr", "c"),
]


@pytest.fixture(scope="module", params=["sf", "odd", "empty"])
def folder(request, spark, tmp_path_factory):
    if request.param == "sf":
        return SF
    path = tmp_path_factory.mktemp(request.param)
    rows = [(*r, 1, "h", 0.5, 3, True) for r in ROWS] if request.param == "odd" else []
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, "Two three, one one"), (2, None), (3, ""), (1, "Two three, one one"), (None, "word5x a xx word5x"), (9, "漢字 nothing")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def winnowed(text, k=4, w=8):
    """Fingerprints by the definition, with every hash and every window written out."""
    tokens = re.findall(fingerprints.PIECE, text or "")
    one = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % fingerprints.PRIME for t in tokens]
    rolled = []
    for part in ([one[i : i + k] for i in range(len(one) - k + 1)] or [one] if one else []):
        h = 0
        for x in part:
            h = (h * fingerprints.BASE + x) % fingerprints.PRIME
        rolled.append(h)
    kept = set()
    for i in range(max(1, len(rolled) - w + 1) if rolled else 0):
        window = rolled[i : i + w]
        kept.add(max(j for j in range(i, i + len(window)) if rolled[j] == min(window)))
    return [(rolled[j], j) for j in sorted(kept)]


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, folder):
    docs = [(d["doc_id"], d["text"] or "") for d in rows(spark, folder, "documents")]
    got = Q["op11_fingerprints"](spark, folder).collect()
    assert Counter((g.doc_id, g.n_chars) for g in got) == Counter((d, len(t)) for d, t in docs)
    as_text = lambda f: " ".join(f"{h:08X}:{p}" for h, p in f)
    texts, by_print = defaultdict(set), {}
    for d, t in docs:
        texts[d].add(t)
        by_print.setdefault(as_text(winnowed(t)), winnowed(t))
    for g in got:
        assert g.fingerprint in {as_text(winnowed(t)) for t in texts[g.doc_id]}
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    if len({d for d, _ in docs}) == len(docs):
        found = {g.doc_id: g for g in got}
        for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
            m = len(t) // 3
            edited, g = t[: len(t) - m] + after[:m], found[d]
            assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert g.edited_fingerprint == as_text(winnowed(edited))
            assert math.isclose(g.near_edited, like(winnowed(t), winnowed(edited))) and math.isclose(g.near_next, like(winnowed(t), winnowed(after)))
    elif docs:  # rows of one id may stand in any order among themselves, but each is followed by a row of its own or the next id
        ids = [d for d, _ in ordered]
        for g in got:
            last = max(i for i, d in enumerate(ids) if d == g.doc_id)
            after = [t for d, t in ordered if d in (g.doc_id, ids[(last + 1) % len(ids)])]
            assert g.edited_sha256 in {hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest() for t in texts[g.doc_id] for x in after}


@pytest.mark.parametrize("k, w", [(1, 1), (2, 4), (8, 2)])
def test_winnow_widths(spark, k, w):
    texts = [None, "", "a", "a b", "a b a b a b a b a b a b a b", " ".join(f"t{i * i % 17}" for i in range(100))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.winnow(F.col("text"), k, w).alias("f")).collect()
    assert [[tuple(x) for x in g.f] for g in got] == [winnowed(t, k, w) for t in texts]
    with pytest.raises(ValueError):
        fingerprints.winnow(F.col("text"), 3, 4)


def test_match_guarantee(spark):
    """Every shared passage of K + W - 1 tokens has a shared fingerprint, at places that lie within it."""
    passage = " ".join(f"p{i}" for i in range(fingerprints.K + fingerprints.W - 1))
    docs = [(i, " ".join(f"d{i}x{j}" for j in range(i)) + " " + passage + f" end{i}") for i in range(40)]
    got = fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    places = defaultdict(dict)
    for g in got:
        places[g.hash][g.doc_id] = g.position
    shared = [p for p in places.values() if len(p) == 40]
    assert shared and all(i <= at <= i + fingerprints.W - 1 for p in shared for i, at in p.items())


@pytest.mark.parametrize("bucket_bytes, bounds", [(1, 1000), (2000, 3)])
def test_next_over_many_buckets(spark, monkeypatch, bucket_bytes, bounds):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(fingerprints, "BOUNDS", bounds)
    ids = [*range(0, 300, 3), 10**12, 10**12 + 1, -5, None]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    got = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    ordered = [f"text of {i}" for i in sorted(ids[:-1], reverse=True)] + ["text of None"]
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1]))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    words = [(d["doc_id"], Counter(TERM.findall(lower(d["text"])))) for d in docs]
    words = [(d, c, sum(c.values())) for d, c in words]
    n_docs, total = sum(n > 0 for *_, n in words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item in items:
        asked, scores = TERM.findall(lower(item["text"])), []
        for d, c, n in words:
            m = 25 + 75 * n * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item["item_id"], r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_search(spark, folder):
    got = [tuple(r) for r in Q["op12_ranked_search"](spark, folder).collect()]
    assert Counter(got) == Counter(ranked(rows(spark, folder, "documents"), rows(spark, folder, "benchmark")))


def test_search_in_small_blocks_groups_and_passes(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = Counter(ranked(docs.collect(), items.collect(), 3))
    monkeypatch.setattr(impact_index, "BLOCK", 70)
    monkeypatch.setattr(impact_index, "GROUP", 7)
    monkeypatch.setattr(impact_index, "PASS_TERMS", 1000)
    monkeypatch.setattr(impact_index, "STEP", 50)
    assert Counter(tuple(r) for r in impact_index.search(docs, items, 3).collect()) == wanted


def test_slices_add_and_select():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 34, (9, 200)) * rng.integers(0, 2, (9, 200))
    terms, slots = np.nonzero(values)
    slices = impact_index.Slices(terms, slots, values[terms, slots], 200)
    total = []
    for t in range(9):
        impact_index.add(total, slices.of(np.arange(9))[:, t, :])
    sums = values.sum(0)
    assert impact_index.best(total, 200) == [(s, int(sums[s])) for s in sorted(range(200), key=lambda s: (-sums[s], s)) if sums[s]]
    assert impact_index.best(total, 5) == impact_index.best(total, 200)[:5]
    assert slices.of(np.array([50]))[:, 0].sum() == 0


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(docs, min_docs=30, top=50):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for d in docs:
        words = LETTERS.findall(lower(d["text"]))
        counts[d["lang"] or "", d["source"] or ""].update(words)
        df[d["lang"] or ""].update(set(words))
    out = []
    for lang in df:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        groups[None] = {t: sum(c[t] for s, c in groups.items()) for t in kept}
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in groups.items()}
        for s in groups.keys() - {None}:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in groups.keys() - {None, s}]
            terms = [(share[None][t] - share[s][t], t.encode(), t) for t in kept if groups[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -f, r) for r, (f, _, item) in enumerate(found, 1)]
    return Counter(out)


def test_divergence(spark, folder):
    docs = rows(spark, folder, "documents")
    assert Counter(tuple(r) for r in Q["op13_source_divergence"](spark, folder).collect()) == audited(docs)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert Counter(tuple(r) for r in divergence.audit(frame, 2, 5).collect()) == audited(docs, 2, 5)


def test_divergence_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_BYTES", 5000)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 50)
    monkeypatch.setattr(divergence, "HELD", 10)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(tuple(r) for r in divergence.audit(docs, 3).collect()) == audited(docs.collect(), 3)
