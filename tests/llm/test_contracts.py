"""Each query against a brute-force version of its contract, on whole tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import queries

Q = queries.queries()
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, title string"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    (1, None, "en", "a", None, "t"),
    (2, "", "en", "a", 0, None),
    (3, " \t\n ", None, None, 3, None),
    (4, "one two three", "en", "a", 13, None),
    (5, "One TWO three", "en", "b", 13, None),
    (5, "One TWO three", "en", "b", 13, None),
    (6, LONG, "en", "a", len(LONG), None),
    (7, LONG + " tail", "en", "a", len(LONG) + 5, None),
    (8, f"start {PASSAGE} end", "en", "hot", 1, None),
    (9, f"{PASSAGE} and {PASSAGE}", "en", "hot", 1, None),
    (10, "<|endoftext|> ünïcode — 漢字 <pad>", "de", "hot", 1, None),
    (11, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "hot", 1, None),
    (12, "\u00a0nbsp\u00a0inside \x0bvertical\x0cfeed", "en", "hot", 1, None),
]


@pytest.fixture(scope="module", params=["sf", "odd", "empty"])
def folder(request, spark, tmp_path_factory):
    if request.param == "sf":
        return SF
    path = tmp_path_factory.mktemp(request.param)
    rows = ODD if request.param == "odd" else []
    some = lambda x: x if rows else []
    write = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    write(rows, DOCS, "documents")
    write(some([(1, "p1 P2 p3 p4 p5 p6 p7 p8 p9 p10 p11"), (2, "two three"), (3, None), (4, ""), (2, "two three"), (5, "a a a")]), "item_id long, text string", "benchmark")
    vec = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)]
    vec += [(300, None), (400, [0.0, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0]), (600, [None, 1.0, 2.0]), (700, [float("inf"), 0.0, 1.0])]
    write(some([(i, v, "x") for i, v in vec]), "vec_id long, embedding array<float>, text string", "embeddings")
    urls = [None, "", "no-scheme.org/es/", "http://EXAMPLE.org/es/1?x#y", "https://a.b.example.org/en/123", "http://notexample.org/es/", "x://shop.com/fr/?q", "http://com/de/", "http://org", "http://org/es/", "https://longhostnameofwords.net/cheap/pills", "http://example.org?/es/", "http://"]
    write(some([(i, u, "<p>", "k") for i, u in enumerate(urls)]), "page_id long, url string, html string, host string", "pages")
    write(some([(1, 0, 0), (4, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)]), "doc_id long, quality int, toxic int", "labels")
    return str(path)


def rows(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def same(got, wanted):
    assert Counter(got) == Counter(wanted)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


WORD = r"[^\x20\x09-\x0D]+"


def test_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Q["op1_harmonic_packing"](spark, folder).collect()
    ids = [(d["doc_id"], tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]) for d in rows(spark, folder, "documents")]
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    by_doc, left = defaultdict(list), defaultdict(list)
    for d, x in ids:
        left[d].append(np.array(x, "<u4"))
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for d, texts in left.items():
        for x in texts:
            fit = [p for p in by_doc[d] if p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())]
            assert len({(p.start, p.length) for p in fit}) * len(texts) >= len(fit)
            assert sum(p.length for p in fit) == len(x) * sum(len(y) == len(x) and (y == x).all() for y in texts)
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    padded = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    if folder == SF:
        assert padded < 0.01 * sum(len(x) for _, x in ids)


def test_decontamination(spark, folder):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item in rows(spark, folder, "benchmark"):
        w = pattern.findall(lower(item["text"]))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item["item_id"])
    sizes = {len(w) for w in windows}
    wanted = []
    for d in rows(spark, folder, "documents"):
        w = pattern.findall(lower(d["text"]))
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        wanted.append((d["doc_id"], len(w), len(hit), len(items), digest, bool(hit)))
    same([tuple(r) for r in Q["op4_decontaminate"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], wanted)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_urls(spark, folder):
    wanted = {}
    for p in rows(spark, folder, "pages"):
        rest = p["url"].split("://", 1)[1] if p["url"] and "://" in p["url"] else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
        fits = [(len(h + q), h + q, v) for h, q, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        wanted[p["page_id"]] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    got = Q["op5_url_filter"](spark, folder).collect()
    assert sorted(r.page_id for r in got) == sorted(wanted)
    for r in got:
        host, path, rule, verdict = wanted[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_ngram_join(spark, folder):
    docs = [(d["doc_id"], re.findall(WORD, lower(d["text"]))) for d in rows(spark, folder, "documents")]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for d, w in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    same([tuple(r) for r in Q["op7_ngram_jaccard"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()], [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)])


def test_substrings(spark, folder):
    docs = [(d["doc_id"], re.findall(WORD, d["text"] or "")) for d in rows(spark, folder, "documents")]
    counts = Counter(tuple(w[i : i + 35]) for _, w in docs for i in range(len(w) - 34))
    wanted = []
    for d, w in docs:
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        wanted.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    same([tuple(r) for r in Q["op8_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], wanted)


def test_substrings_of_repeated_rows(spark):
    from larkspur.llm import substrings

    text = " ".join(f"r{i % 50}" for i in range(400))
    docs = spark.createDataFrame([(1, text)] * 600 + [(2, text + " tail")], "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == {(1, 400, 400, ""): 600, (2, 401, 400, "tail"): 1}


def test_neighbors(spark, folder):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    vectors = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in rows(spark, folder, "embeddings") if ok(r["embedding"]))
    got = defaultdict(list)
    for r in Q["op10_nearest_neighbors"](spark, folder).collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i, _ in vectors if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        at = dict(vectors)[q]
        best = sorted((float(np.sqrt(((v - at) ** 2).sum())), i) for i, v in vectors if i != q)[:10]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(best) + 1))
        for r in found:
            assert r.score == pytest.approx(float(np.sqrt(((dict(vectors)[r.vec_id] - at) ** 2).sum())), rel=1e-12)
        hits += len({i for _, i in best} & {r.vec_id for r in found})
        total += len(best)
    assert hits >= 0.9 * total


def test_scores_cover_all_documents(spark, folder):
    ids = sorted(d["doc_id"] for d in rows(spark, folder, "documents"))
    tox = Q["op3_toxicity"](spark, folder).collect()
    assert sorted(r.doc_id for r in tox) == ids
    for r in tox:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for name in ("op2_license_scan", "op6_quality_cotraining", "op9_pii_surrogates"):
        assert sorted(r.doc_id for r in Q[name](spark, folder).collect()) == ids, name


FEW = pytest.mark.xfail(reason="37 toxic rows to learn from, 13 of them in three languages: measured 0.82")


@pytest.mark.parametrize("sf_dir", [pytest.param("/root/testdata/sf0.01", marks=FEW), "/root/testdata/sf0.1"])
def test_toxicity_on_held_out_rows(spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in rows(spark, sf_dir, "labels")}
    held = [(r.score, labels[r.doc_id]) for r in Q["op3_toxicity"](spark, sf_dir).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) >= 0.9


def test_quality_agrees_with_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows(spark, "/root/testdata/sf0.01", "labels")}
    seen = [(r.keep, labels[r.doc_id]) for r in Q["op6_quality_cotraining"](spark, "/root/testdata/sf0.01").collect() if labels.get(r.doc_id) is not None]
    assert np.mean([k == bool(y) for k, y in seen]) >= 0.85
    assert np.mean([k for k, y in seen if y]) >= 0.9
