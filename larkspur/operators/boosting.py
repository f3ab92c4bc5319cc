"""Boosted oblivious trees, trained where the rows are.

Features are sparse maps, absent ones 0.  Each has borders at quantiles of its
values; a row keeps the numbers of the borders on whose other side it lies than
0 does.  A level of a tree is one pass: workers sum gradients by model, border
and leaf, Spark adds the sums up and takes for each model the border that
gains most, and only that comes to the driver.  The models of all folds, each
without the rows of its fold, and the model of all rows grow in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.features import numbered_names
from larkspur.operators.model import BORDERS, DEPTH, ITERATIONS, L2, RATE, TreeModel
from larkspur.operators.tables import cut

FOLDS = 5
#: Bits of a value's fraction that count for its quantiles, so that a feature has boundedly many distinct values; trees between two writes of the rows' scores.
FRACTION_BITS, TREES_WRITTEN = 16, 16
#: More than the borders of any feature: a border's number is its feature's times this, and its place.
_WIDTH = BORDERS + 2


@dataclass
class Trained:
    """A model of all rows, and for each fold how many of the others' positives held: (true, false) positives of rows it had not seen."""

    model: TreeModel
    folds: list[tuple[int, int]]

    @property
    def precision(self) -> list[float | None]:
        return [t / (t + f) if t + f else None for t, f in self.folds]


@dataclass
class _Growing:
    base: float
    trees: list[tuple[list[tuple[int, bool]], np.ndarray]] = field(default_factory=list)
    #: splits of the tree that grows: a border's number, and whether 0 lies above it
    splits: list[tuple[int, bool]] = field(default_factory=list)
    #: trees whose values stand in the rows' scores already
    written: int = 0


def borders(rows: DataFrame, n: int) -> DataFrame:
    """name, number and borders of each feature of ``rows`` (features), of which there are n: midpoints of its values, or of their quantiles where they are many."""
    value = F.col("value").cast("float").cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - FRACTION_BITS)
    values = rows.select(F.explode("features").alias("name", "value")).withColumn("value", F.coalesce(value, F.lit(0.0)))
    values = values.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.round(value / unit) * unit)).groupBy("name", "value").count()
    absent = values.groupBy("name").agg(F.sum("count").alias("held")).where(F.col("held") < n).select("name", F.lit(0.0).alias("value"), (F.lit(n) - F.col("held")).alias("count"))
    counted = values.unionByName(absent).groupBy("name", "value").agg(F.sum("count").alias("count"))
    distinct = counted.groupBy("name").agg(F.count("*").alias("distinct"))
    upto = F.sum("count").over(Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    place = lambda i: F.bround(i / (BORDERS + 1) * (n - 1))
    quantile = F.exists(F.sequence(F.lit(0), F.lit(BORDERS + 1)), lambda i: (place(i) < F.col("upto")) & (place(i) >= F.col("upto") - F.col("count")))
    kept = counted.withColumn("upto", upto).join(distinct, "name").where((F.col("distinct") <= BORDERS + 1) | quantile)
    lists = kept.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("v"))  # at most BORDERS + 2
    middle = F.transform(F.slice("v", 2, _WIDTH), lambda x, i: ((x + F.get("v", i)) / 2).cast("float"))
    return numbered_names(rows, F.lit(0)).join(lists, "name").select("name", F.col("number").cast("int").alias("number"), middle.alias("borders"))


def _binned(rows: DataFrame, table: DataFrame, models: int) -> DataFrame:
    """id, y, fold, the numbers of the borders between a row's values and 0, and the row's scores so far."""
    each = rows.select("id", F.explode("features").alias("name", "value")).join(table, "name")
    value = F.coalesce(F.col("value").cast("float"), F.lit(0.0).cast("float"))
    crossed = F.filter(F.transform("borders", lambda b, i: F.when((value > b) != (b < 0), F.col("number") * _WIDTH + i)), lambda x: x.isNotNull())
    bits = each.select("id", F.explode(crossed).alias("bit")).groupBy("id").agg(F.collect_list("bit").alias("bits"))  # as many as a row's own values cross
    return rows.select("id", "y", "fold").join(bits, "id", "left").select("y", "fold", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"), F.array_repeat(F.lit(0.0), models).alias("scores"))


class _Batch:
    """Rows with their leaves and gradients under the models as they are."""

    def __init__(self, batch: pa.RecordBatch, models: list[_Growing]):
        self.y, self.fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(2)
        self.row, self.bit = np.repeat(np.arange(len(self.y)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        self.scores = np.array(batch.column(3).flatten().to_numpy(), float).reshape(len(self.y), len(models))
        used = np.unique(np.array([b for m in models for s in [*(t[0] for t in m.trees[m.written :]), m.splits] for b, _ in s], np.int64))
        at = np.searchsorted(used, self.bit)
        hit = np.flatnonzero((at < len(used)) & (used[np.minimum(at, len(used) - 1)] == self.bit)) if len(used) else np.zeros(0, np.int64)
        self.used, self.crossed = used, np.zeros((len(self.y), len(used)), bool)
        self.crossed[self.row[hit], at[hit]] = True

    def leaves(self, splits: list[tuple[int, bool]]) -> np.ndarray:
        out = np.zeros(len(self.y), np.int64)
        for level, (bit, above) in enumerate(splits):
            out |= (self.crossed[:, np.searchsorted(self.used, bit)] ^ above).astype(np.int64) << level
        return out

    def raw(self, i: int, model: _Growing) -> np.ndarray:
        out = self.scores[:, i].copy()
        for splits, values in model.trees[model.written :]:
            out += values[self.leaves(splits)]
        return out


def _sums(binned: DataFrame, models: list[_Growing], by_border: bool) -> DataFrame:
    """model, bit, leaf, g and n: gradients and rows by leaf (bit -1), and by leaf and crossed border where asked for."""
    n_folds = len(models) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Batch(batch, models)
            for i, model in enumerate(models):
                inside = (rows.fold != i) if i < n_folds else np.ones(len(rows.y), bool)
                grad = np.where(inside, rows.y - 1 / (1 + np.exp(-(model.base + rows.raw(i, model)))), 0.0)
                leaf, size = rows.leaves(model.splits), 1 << len(model.splits)
                parts = [(np.full(len(leaf), -1), leaf, grad, inside)]
                if by_border:
                    parts.append((rows.bit, leaf[rows.row], grad[rows.row], inside[rows.row]))
                for bit, where, g, n in parts:
                    key, at = np.unique(bit.astype(np.int64) * size + where, return_inverse=True)
                    columns = [pa.array(np.full(len(key), i, np.int32)), pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), *(pa.array(np.bincount(at, w, len(key)), pa.float64()) for w in (g, n))]
                    yield pa.RecordBatch.from_arrays(columns, names=["model", "bit", "leaf", "g", "n"])

    sums = binned.mapInArrow(run, "model int, bit int, leaf int, g double, n double")
    return sums.groupBy("model", "bit", "leaf").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _best(sums: DataFrame, l2: float) -> dict[int, int]:
    """For each model the border that gains most over all leaves; the first of equals."""
    total = sums.where("bit < 0").select("model", "leaf", F.col("g").alias("tg"), F.col("n").alias("tn"))
    both = sums.where("bit >= 0").join(F.broadcast(total), ["model", "leaf"])  # a row for each model and leaf
    square = lambda g, n: g * g / (n + l2)
    more = square(F.col("g"), F.col("n")) + square(F.col("tg") - F.col("g"), F.col("tn") - F.col("n")) - square(F.col("tg"), F.col("tn"))
    gains = both.groupBy("model", "bit").agg(F.round(F.sum(more), 9).alias("gain"))
    return {r[0]: -r[1]["bit"] for r in gains.groupBy("model").agg(F.max(F.struct("gain", (-F.col("bit")).alias("bit")))).collect()}


def _written(binned: DataFrame, models: list[_Growing]) -> DataFrame:
    """The rows with the trees grown so far in their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Batch(batch, models)
            scores = np.stack([rows.raw(i, m) for i, m in enumerate(models)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(scores), pa.list_(pa.float64()))], names=batch.schema.names)

    out = cut(binned.mapInArrow(run, binned.schema))
    for m in models:
        m.written = len(m.trees)
    return out


def train(featured: DataFrame, label: str = "label", iterations: int = ITERATIONS, depth: int = DEPTH, rate: float = RATE, l2: float = L2, folds: int = FOLDS) -> Trained:
    """Trees from all rows (features, ``label`` of 0 or 1); rows without a label are left out.

    A fold is a hash of a row's features, so rows that repeat are in one fold.
    On the driver are the models and, for each level, one border a model.
    """
    rows = featured.where(F.col(label).isNotNull()).select("features", F.col(label).cast("double").alias("y"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.to_json("features")), F.lit(max(folds, 1))).cast("int"))
    rows = cut(rows.withColumn("features", F.coalesce("features", F.create_map().cast("map<string,double>"))).withColumn("id", F.monotonically_increasing_id()))
    n = {r[0]: (r[1], r[2]) for r in rows.groupBy("fold").agg(F.count("*"), F.sum("y")).collect()}
    n_rows, positive = sum(c for c, _ in n.values()), sum(s for _, s in n.values())
    table = cut(borders(rows, n_rows))
    models = []
    for i in range(folds + 1):
        without = n.get(i, (0, 0.0)) if i < folds else (0, 0.0)
        share = (positive - without[1]) / (n_rows - without[0]) if n_rows > without[0] else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        models.append(_Growing(float(np.log(share / (1 - share)))))
    binned = cut(_binned(rows, table, len(models)))
    known: dict[int, tuple[str, list[float]]] = {}  # the features of splits
    for _ in range(iterations):
        for _ in range(depth):
            best = _best(_sums(binned, models, True), l2)
            if len(best) < len(models):
                break
            asked = {bit // _WIDTH for bit in best.values()} - known.keys()
            known |= {r.number: (r.name, list(r.borders)) for r in table.where(F.col("number").isin(list(asked))).collect()} if asked else {}
            for i, bit in best.items():
                models[i].splits.append((bit, known[bit // _WIDTH][1][bit % _WIDTH] < 0))
        if len(models[-1].splits) < depth:  # nothing to split by
            break
        sums = {(r.model, r.leaf): (r.g, r.n) for r in _sums(binned, models, False).collect()}  # a row for each model and leaf
        for i, m in enumerate(models):
            leaf = [sums.get((i, j), (0.0, 0.0)) for j in range(1 << depth)]
            m.trees.append((m.splits, np.array([rate * 4 * g / (c + l2) for g, c in leaf])))
            m.splits = []
        if len(models[0].trees) - models[0].written >= TREES_WRITTEN:
            binned = _written(binned, models)
    binned = _written(binned, models)
    raw = F.get("scores", F.col("fold")) + F.get(F.array(*[F.lit(m.base) for m in models]), F.col("fold"))
    judged = {r[0]: (r[1], r[2]) for r in binned.groupBy("fold").agg(F.count_if((raw > 0) & (F.col("y") > 0)), F.count_if((raw > 0) & (F.col("y") <= 0))).collect()} if folds else {}
    return Trained(TreeModel(_spec(models[-1], known)), [judged.get(i, (0, 0)) for i in range(folds)])


def _spec(model: _Growing, known: dict[int, tuple[str, list[float]]]) -> dict:
    """The model's specification, with the features that it splits by."""
    numbers = sorted({bit // _WIDTH for splits, _ in model.trees for bit, _ in splits}, key=lambda n: known[n][0])
    specs, at, offset = [], {}, 0
    for i, number in enumerate(numbers):
        name, levels = known[number]
        specs.append({"feature_id": name, "feature_index": i, "flat_feature_index": i, "borders": levels, "has_nans": False, "nan_value_treatment": "AsIs"})
        at[number] = (i, offset)
        offset += len(levels)
    split = lambda bit: {"split_type": "FloatFeature", "float_feature_index": at[bit // _WIDTH][0], "split_index": at[bit // _WIDTH][1] + bit % _WIDTH, "border": known[bit // _WIDTH][1][bit % _WIDTH]}
    trees = [{"leaf_values": values.tolist(), "splits": [split(bit) for bit, _ in splits]} for splits, values in model.trees]
    return {"features_info": {"float_features": specs}, "oblivious_trees": trees, "scale_and_bias": [1.0, [model.base]]}
