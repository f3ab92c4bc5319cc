"""The stages of the pipeline against brute force, each on what the one before it kept."""

import re
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from larkspur.llm import pii, quality  # noqa: E402

from test_contracts import ODD  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, n_entities string, found string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


NEAR = " ".join(f"n{i}" for i in range(100))
CASES = [
    *[(*r[:5], "k", "n", "f") for r in ODD],
    (1, "same words here again and again", "en", "a", 1, "x", None, None),
    (1, "same words here again and again", "en", "a", 1, "x", None, None),
    (1, "same words here again and again", "en", "a", 1, "y", None, None),
    (None, "null ids of one group of texts", "en", "a", 1, None, None, None),
    (None, "null ids of one group of texts", "en", "a", 1, None, None, None),
    (30, NEAR + " one", "en", "a", 1, None, None, None),
    (30, NEAR + " two", "en", "a", 1, None, None, None),
    (None, NEAR + " three", "en", "a", 1, None, None, None),
    (31, "", "en", "a", 0, None, None, None),
    (31, "", "en", "a", 0, None, None, None),
    (32, "a p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 b", "en", "a", 0, None, None, None),
    (33, "mail ann@corp.example.org now", "en", "a", 29, None, None, None),
]


@pytest.fixture(scope="module", params=["sf", "odd", "empty"])
def given(request, spark, tmp_path_factory):
    """The folder of the other tables, and the documents of the first stage."""
    if request.param == "sf":
        return SF, spark.read.parquet(f"{SF}/documents.parquet")
    path = tmp_path_factory.mktemp("tables")
    rows = CASES if request.param == "odd" else []
    spark.createDataFrame([(1, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (None, 0)] if rows else [], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), spark.read.parquet(f"{path}/documents.parquet")


def test_stages(spark, given, tmp_path):
    folder, docs = given
    before, states = docs, [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{i}")
        before = spark.read.parquet(f"{tmp_path}/{i}")
        states.append(before)
        if i < 4:
            assert before.columns == docs.columns
    start, good, single, clean, private, packed = states
    # quality: as the operator's own scores say, row by row
    model = quality.fit(start, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = defaultdict(list)
    for r in quality.score(start, model).collect():
        scores[r._k1, r._k2].append(r.score)
    assert good.count() == sum(s >= quality.KEEP_FROM for x in scores.values() for s in x)
    # near duplicates: one row of each group
    rows = rows_of(good)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(WORD, lower(r[1]))) else set() for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[find(i)].append(rows[i])
    kept = rows_of(single)
    assert len(kept) == len(groups) and not Counter(kept) - Counter(rows)
    left = Counter(kept)
    for members in groups.values():
        least = min((r[0] for r in members if r[0] is not None), default=None)
        hit = [r for r in members if left[r] and r[0] == least]
        assert hit
        left[hit[0]] -= 1
    # contamination: no window of ten benchmark words, nor a whole shorter item
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = pattern.findall(lower(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    dirty = lambda text: any(tuple(w[i : i + k]) in windows for w in [pattern.findall(lower(text))] for k in sizes for i in range(len(w) - k + 1))
    assert Counter(rows_of(clean)) == Counter(r for r in kept if not dirty(r[1]))
    # personal data: the operator's texts, other columns untouched but for n_chars
    texts = Counter((r.doc_id, r.text) for r in pii.pseudonymise(clean, pii.QUERY_KEY).collect())
    assert Counter((r[0], r[1]) for r in rows_of(private)) == texts
    for r in private.collect():
        assert "ann@corp" not in (r.text or "")
    # packing: each row's ids once, and no document that an earlier stage dropped
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(r[0] for r in rows_of(private))
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.where("start = 0").collect())
