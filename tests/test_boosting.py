"""Training over all rows against the fit of dense rows in one place."""

import numpy as np
import pytest

from larkspur.operators import boosting, model
from larkspur.operators.model import BORDERS

def fit(x: np.ndarray, y: np.ndarray, names: list[str], iterations: int, depth: int, rate: float, l2: float) -> dict:
    """The specification of a model fitted on dense rows, in one place: what the training has to equal."""
    specs, columns, offset = [], [], 0
    for i, name in enumerate(names):
        values = np.unique(x[:, i])
        if len(values) > BORDERS + 1:
            values = np.unique(np.quantile(x[:, i], np.linspace(0, 1, BORDERS + 2), method="nearest"))
        borders = ((values[1:] + values[:-1]) / 2).astype(np.float32)
        specs.append({"feature_id": name, "feature_index": i, "flat_feature_index": i, "borders": borders.tolist(), "has_nans": False, "nan_value_treatment": "AsIs"})
        columns += [(x[:, i] > b, i, float(b)) for b in borders]
        offset += len(borders)
    bits = np.array([c[0] for c in columns]) if columns else np.zeros((0, len(y)), bool)
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    raw, trees = np.full(len(y), np.log(base / (1 - base))), []
    for _ in range(iterations if len(bits) else 0):
        grad = y - 1 / (1 + np.exp(-raw))
        leaf, splits = np.zeros(len(y), np.int64), []
        for level in range(depth):
            n = 1 << level
            total, count = np.bincount(leaf, grad, n), np.bincount(leaf, minlength=n).astype(float)
            member = np.zeros((len(y), n))
            member[np.arange(len(y)), leaf] = 1
            right, n_right = bits @ (member * grad[:, None]), bits @ member
            left, n_left = total - right, count - n_right
            gain = (right**2 / (n_right + l2) + left**2 / (n_left + l2)).sum(1)
            best = int(gain.argmax())
            splits.append(best)
            leaf |= bits[best].astype(np.int64) << level
        n = 1 << depth
        values = rate * 4 * np.bincount(leaf, grad, n) / (np.bincount(leaf, minlength=n) + l2)
        raw = raw + values[leaf]
        trees.append({"leaf_values": values.tolist(), "splits": [{"split_type": "FloatFeature", "float_feature_index": columns[s][1], "split_index": s, "border": columns[s][2]} for s in splits]})
    return {"features_info": {"float_features": specs}, "oblivious_trees": trees, "scale_and_bias": [1.0, [float(np.log(base / (1 - base)))]]}


SCHEMA = "features map<string,double>, label int"


def table(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 200, n) / 8, rng.integers(-3, 4, n), rng.integers(0, 2, n) * rng.integers(0, 90, n), np.ones(n)], 1).astype(np.float32)
    y = ((x[:, 0] > 11) ^ (x[:, 1] > 0) | (rng.random(n) < 0.1)).astype(int)
    names = ["a", "b", "sparse", "same"]
    # a zero is absent, or there, or null
    rows = [({k: (None if v == 0 and i % 3 == 0 else float(v)) for k, v in zip(names, r) if v != 0 or i % 3 < 2}, int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, names, rows


def test_equal_to_the_fit_in_one_place(spark):
    x, y, names, rows = table(1000)
    order = np.argsort(names)
    wanted = model.TreeModel(fit(x[:, order], y.astype(float), sorted(names), 4, 3, 0.3, 2.0))
    got = boosting.train(spark.createDataFrame(rows, SCHEMA).repartition(5), iterations=4, depth=3, rate=0.3, l2=2.0, folds=2)
    records = [{k: v for k, v in r.items() if v is not None} for r, _ in rows]
    assert np.allclose(got.model.raw_of_records(records), wanted.raw_of_records(records), atol=1e-4)
    used = {f["feature_id"]: f["borders"] for f in got.model.spec["features_info"]["float_features"]}
    whole = {f["feature_id"]: f["borders"] for f in wanted.spec["features_info"]["float_features"]}
    assert used and all(np.allclose(used[k], whole[k]) for k in used)
    assert len(got.folds) == 2 and all(p > 0.8 for p in got.precision)


def test_scores_written_between_trees_change_nothing(spark, monkeypatch):
    _, _, _, rows = table(200, 2)
    frame = spark.createDataFrame([*rows, ({"a": 1.0}, None), (None, 1)], SCHEMA)
    args = dict(iterations=3, depth=2, rate=0.5, l2=1.0, folds=0)
    once = boosting.train(frame, **args).model.raw_of_records([r for r, _ in rows])
    monkeypatch.setattr(boosting, "TREES_WRITTEN", 1)
    assert np.allclose(boosting.train(frame, **args).model.raw_of_records([r for r, _ in rows]), once)


@pytest.mark.parametrize("rows", [[], [({"a": 1.0}, 1)], [({}, 0), (None, 1)]])
def test_tables_without_anything_to_split(spark, rows):
    got = boosting.train(spark.createDataFrame(rows, SCHEMA), iterations=2, depth=2, folds=2)
    assert got.model.spec["oblivious_trees"] == [] and got.precision == [None, None] or rows
