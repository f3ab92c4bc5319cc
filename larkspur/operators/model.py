"""Oblivious-tree models: loading and scoring; ``boosting`` trains them.

A model is JSON (or gzipped JSON) with float features and their borders,
oblivious trees (split indices and leaf values), and a scale and bias.  Scores
are computed in 32-bit floats in a fixed order of trees, for whole batches.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.dealing import slices

ITERATIONS, DEPTH, RATE, L2, BORDERS = 350, 5, 0.03, 15.0, 32


@dataclass
class Feature:
    name: str
    index: int
    offset: int
    borders: np.ndarray
    nan_is_true: bool


class TreeModel:
    """A prepared model."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.features: list[Feature] = []
        self.width = self.bits = 0
        for f in spec["features_info"]["float_features"]:
            self.width = max(self.width, f["flat_feature_index"] + 1)
            borders = np.array(f.get("borders") or [], np.float32)
            if len(borders):
                self.features.append(Feature(f["feature_id"], f["flat_feature_index"], self.bits, borders, bool(f.get("has_nans")) and f.get("nan_value_treatment") == "AsTrue"))
            self.bits += len(borders)
        self.features.sort(key=lambda f: f.name)
        self.trees = [(np.array([s["split_index"] for s in t.get("splits") or []], int), np.array(t["leaf_values"], np.float32)) for t in spec["oblivious_trees"]]
        scale, bias = spec.get("scale_and_bias") or [1.0, [0.0]]
        self.scale, self.bias = np.float32(scale), np.float32((bias if isinstance(bias, list) else [bias])[0])

    @classmethod
    def load(cls, data: bytes) -> TreeModel:
        """A model from the bytes of its file, gzipped or not."""
        return cls(json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))

    def _binary(self, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, self.bits), bool)
        for f in self.features:
            x = values[f.name]
            bit = x[:, None] > f.borders[None]
            bit[np.isnan(x)] = f.nan_is_true
            out[:, f.offset : f.offset + len(f.borders)] = bit
        return out

    def _raw(self, bits: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bits), np.float32)
        for splits, leaves in self.trees:
            at = (bits[:, splits].astype(np.int64) << np.arange(len(splits))).sum(1)
            total = total + leaves[at]
        return total * self.scale + self.bias

    def raw_of_records(self, records: list[dict[str, float] | None]) -> np.ndarray:
        """The sum of leaves of each record; absent features are 0."""
        values = {f.name: np.array([(r or {}).get(f.name) or 0.0 for r in records], np.float32) for f in self.features}
        return self._raw(self._binary(values, len(records)))

    def raw_of_vectors(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaves of each dense row, which has to have as many numbers as the model has features."""
        if x.ndim != 2 or x.shape[1] != self.width:
            raise ValueError(f"the model has {self.width} features, the rows have {x.shape[-1]}")
        x = x.astype(np.float32)
        return self._raw(self._binary({f.name: x[:, f.index] for f in self.features}, len(x)))


def sigmoid(raw: np.ndarray) -> np.ndarray:
    """In 32-bit floats."""
    with np.errstate(over="ignore"):
        return np.float32(1) / (np.float32(1) + np.exp(-raw.astype(np.float32)))


def load(spark, path: str) -> TreeModel:
    """A model from any store that Spark reads."""
    return TreeModel.load(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def with_score(featured: DataFrame, model: TreeModel) -> DataFrame:
    """``featured`` with ``score``, from 0 to 1, by its map ``features``; a null map scores 0."""
    schema, at = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in featured.schema.fields), featured.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            records = [None if m is None else dict(m) for m in batch.column(at).to_pylist()]
            out = sigmoid(model.raw_of_records(records)).astype(float)
            out[[r is None for r in records]] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return featured.mapInArrow(run, f"{schema}, score double")


def scored(featured: DataFrame, model: TreeModel | None, least: float = 0.0) -> DataFrame:
    """Rows with ``score`` (0 without a model) of at least ``least``."""
    out = featured.withColumn("score", F.lit(0.0)) if model is None else with_score(featured, model)
    return out.where(F.col("score") >= least) if least > 0 else out
