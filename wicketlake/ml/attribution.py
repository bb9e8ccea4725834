"""Exact Shapley attribution of boosted trees.

The worth of a set of features is the expected score of a tree when only they
are known: a split on a known feature follows the row, any other split takes
both sides in proportion to the training rows that go there. The score is a
sum over leaves, and a leaf's share depends on its path alone: with o_j (1 if
the row meets the path's conditions on feature j, else 0) and z_j (the share of
training rows that do), a set S of known features gives the leaf value x the
product of o_j over S and of z_j over the others.

A path of d features therefore has 2^d cases. For each case the path is
extended feature by feature (the polynomial product of z_j + o_j y), and each
feature is unwound from it (polynomial division), which leaves the weights of
all set sizes without that feature; their Shapley sum times (o_j - z_j) is the
feature's attribution. These tables depend on the model only, so they are made
once (200 trees of depth 4 have 3,200 paths of at most 16 cases) and shipped
with the tasks, which look up one case per path and row in Arrow batches.
Attributions and the base value add up to the model's raw score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.session import ship_package


@dataclass
class Path:
    """A leaf: its weighted value and, per feature met on the way, the open
    lower and closed upper bound and the steps (node, side) taken on it."""

    value: float
    bounds: dict[int, tuple[float, float]]
    steps: dict[int, list[tuple[int, int]]]
    nodes: list[int]


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def paths_of(description: str, weight: float, first_node: int = 0) -> list[Path]:
    """The leaves of a tree from its ``toDebugString``: nodes are numbered in
    the order of their lines."""
    lines = [x.strip() for x in description.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    out: list[Path] = []
    at, node = 0, first_node - 1

    def walk(bounds, steps, nodes) -> None:
        nonlocal at, node
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            out.append(Path(weight * float(line.split(":")[1]), bounds, steps, nodes))
            return
        node += 1
        own, split = node, _SPLIT.match(line)
        feature, threshold = int(split[1]), float(split[2])
        low, high = bounds.get(feature, (-np.inf, np.inf))
        for side, kept in ((0, (low, min(high, threshold))), (1, (max(low, threshold), high))):
            if side:
                at += 1  # the Else line
            walk(bounds | {feature: kept}, steps | {feature: [*steps.get(feature, []), (own, side)]}, [*nodes, own])

    walk({}, {}, [])
    return out


def model_paths(model) -> list[Path]:
    """All leaves of a boosted-tree model (the last stage of a pipeline)."""
    gbt = model.stages[-1] if hasattr(model, "stages") else model
    out: list[Path] = []
    for tree, weight in zip(gbt.trees, gbt.treeWeights, strict=True):
        node = max((n for p in out for n in p.nodes), default=-1) + 1 if out else 0
        out += paths_of(tree.toDebugString, weight, node)
    return out


def meets(path: Path, feature: int, x: np.ndarray) -> np.ndarray:
    low, high = path.bounds[feature]
    return (x[:, feature] > low) & (x[:, feature] <= high)


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float)


def _doubles(data: DataFrame, cols: list[str]) -> list:
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in cols]


def leaf_covers(paths: list[Path], data: DataFrame, cols: list[str]) -> np.ndarray:
    """How many rows of ``data`` end in each leaf (one partial sum per task)."""
    ship_package(data.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(paths), np.int64)
        for batch in batches:
            x = _matrix(batch, cols)
            for i, p in enumerate(paths):
                inside = np.ones(len(x), bool)
                for f in p.bounds:
                    inside &= meets(p, f, x)
                total[i] += inside.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(paths)), pa.int32()), pa.array(total)], names=["leaf", "n"])

    out = np.zeros(len(paths), np.int64)
    for r in data.select(*_doubles(data, cols)).mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out[r.leaf] = r.n  # one row per leaf of the model
    return out


def shares(paths: list[Path], covers: np.ndarray) -> list[dict[int, float]]:
    """Per path and feature, the share of rows that its splits on that feature
    send the path's way. A node without rows splits evenly."""
    below: dict[tuple[int, int], int] = {}
    for p, n in zip(paths, covers):
        for taken in p.steps.values():
            for step in taken:
                below[step] = below.get(step, 0) + int(n)

    def share(node: int, side: int) -> float:
        both = below[node, 0] + below[node, 1]
        return below[node, side] / both if both else 0.5

    return [{f: float(np.prod([share(*s) for s in taken])) for f, taken in p.steps.items()} for p in paths]


def extend(weights: np.ndarray, z: float, o: int) -> np.ndarray:
    """The path's set weights with one more feature: times (z + o y)."""
    return np.append(z * weights, 0.0) + np.append(0.0, o * weights)


def unwind(weights: np.ndarray, z: float, o: int) -> np.ndarray:
    """The path's set weights without one feature: divided by (z + o y)."""
    if not o:
        return weights[:-1] / z
    out = np.zeros(len(weights) - 1)
    carry = 0.0
    for k in range(len(out) - 1, -1, -1):
        carry = out[k] = weights[k + 1] - z * carry
    return out


def case_table(value: float, z: list[float]) -> np.ndarray:
    """Attributions of a path's features in each of its 2^d cases; bit j of
    the case says whether the row meets the conditions on feature j."""
    d = len(z)
    table = np.zeros((1 << d, d))
    sizes = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    for case in range(1 << d):
        o = [case >> j & 1 for j in range(d)]
        weights = np.ones(1)
        for zj, oj in zip(z, o):
            weights = extend(weights, zj, oj)
        for j in range(d):
            if o[j] or z[j]:
                left = unwind(weights, z[j], o[j])
            else:  # neither the row nor any training row: the product of the others
                left = np.ones(1)
                for k in range(d):
                    if k != j:
                        left = extend(left, z[k], o[k])
            table[case, j] = value * (o[j] - z[j]) * (sizes @ left)
    return table


@dataclass
class Explainer:
    """The case tables of a model's paths, and its base value: the expected
    raw score over the training rows."""

    paths: list[Path]
    tables: list[np.ndarray]
    base: float

    @classmethod
    def of(cls, model, background: DataFrame, cols: list[str]) -> Explainer:
        paths = model_paths(model)
        z = shares(paths, leaf_covers(paths, background, cols))
        tables = [case_table(p.value, [zs[f] for f in p.bounds]) for p, zs in zip(paths, z)]
        base = float(sum(p.value * np.prod(list(zs.values())) for p, zs in zip(paths, z)))
        return cls(paths, tables, base)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for p, table in zip(self.paths, self.tables):
            case = np.zeros(len(x), np.int64)
            for j, f in enumerate(p.bounds):
                case |= meets(p, f, x).astype(np.int64) << j
            for j, f in enumerate(p.bounds):
                out[:, f] += table[case, j]
        return out


def row_attributions(explainer: Explainer, data: DataFrame, cols: list[str], key: str) -> DataFrame:
    """``(key, feature, attribution)``, one row per row of ``data`` and
    feature, in the model's raw score; a map, no shuffle."""
    ship_package(data.sparkSession)
    own = data.select(F.col(key).cast("string").alias(key), *_doubles(data, cols))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = explainer.attributions(_matrix(batch, cols))
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k in keys for _ in cols], pa.string()), pa.array(cols * len(keys), pa.string()), pa.array(phi.ravel())],
                names=[key, "feature", "attribution"])

    return own.mapInArrow(explain, f"`{key}` string, feature string, attribution double")


def mean_attributions(rows: DataFrame) -> DataFrame:
    """The mean absolute attribution per feature, largest first."""
    return rows.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution")).orderBy(
        F.col("mean_abs_attribution").desc(), "feature")
