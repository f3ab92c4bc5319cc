"""The bitmap filter bounds overlaps, and groups whose members miss the threshold keep all their links."""

import random
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import ngram_join


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(500)) if rng.random() < share else w for w in words]


def test_bits_never_differ_more_than_sets():
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    texts = [" ".join(edited(rng, base[:n], share)).encode() for n in (0, 3, 10, 40, 100, 300, 600, 1500) for share in (0, 0.003, 0.05, 0.3)]
    maps = ngram_join.bitmaps(texts)
    doc, g = ngram_join.shingle_sets(texts)
    sets = [set(g[doc == k].tolist()) for k in range(len(texts))]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    whole = ngram_join.Bitmaps(maps)
    true = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j)])
    for bits in (ngram_join.differing(whole, i, whole, j), ngram_join.differing(whole, i, ngram_join.Bitmaps(maps[::-1]), len(texts) - 1 - j)):
        assert (bits <= true).all()
        assert (bits[i == j] == 0).all()
    few = (true > 0) & (true < 80) & (np.array([min(len(sets[a]), len(sets[b])) for a, b in zip(i, j)]) > 100)
    assert few.any() and (bits[few] > 0).all()


@pytest.mark.parametrize(("hot", "block"), [(ngram_join.HOT, ngram_join.BLOCK), (20, 16)])
def test_group_of_mixed_distance(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06]))) for _ in range(150)]
    got = {r.doc_id: r.component_id for r in ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got == dict(enumerate(root))
    sizes = defaultdict(int)
    for r in root:
        sizes[r] += 1
    assert len(sizes) > 1 and max(sizes.values()) > 2
