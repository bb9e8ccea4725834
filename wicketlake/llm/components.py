"""Connected components of an edge table by hooking and pointer jumping.

Each round hooks every node to its smallest neighbour (a partial aggregate),
halves the parent chains until they are flat, and contracts the edges to the
roots. Edges and chains shrink by a constant factor at least, so the rounds
are logarithmic in the longest chain. All state is a table under the shared
checkpoint folder; a node with very many edges is one aggregated row on the
one side of each join, and Spark splits the other side. Up to ``ONE_TASK``
counted edges one task goes these rounds over arrays: dozens of short jobs
take longer than that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import written

#: Edges up to which the components are found in one task, in about 100 MB.
ONE_TASK = 1_000_000


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of all edges ``(a, b)``."""
    import numpy as np

    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[:len(at) // 2], at[len(at) // 2:]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up = np.arange(len(nodes))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k:k + 100_000]), pa.array(nodes[label[k:k + 100_000]])], names=["node", "component"])


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; the component
    is the smallest node in it. Loops and repeated edges do no harm."""
    def contracted(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    rest = written(contracted(edges), f"{name}-edges")
    total, count = None, rest.count()
    if 0 < count <= ONE_TASK and dict(rest.dtypes)["a"] == "bigint":
        return written(rest.coalesce(1).mapInArrow(_components, "node bigint, component bigint"), f"{name}-components")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), f"{name}-parents")
        while True:
            above = parent.select(F.col("node").alias("component"), F.col("component").alias("next"))
            jumped = written(parent.join(above, "component").select("node", "component", "next"), f"{name}-jump")
            parent = jumped.select("node", F.col("next").alias("component"))
            if jumped.filter("next <> component").isEmpty():
                break
        a, b = (parent.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in ("a", "b"))
        rest = written(contracted(rest.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))),
                       f"{name}-edges")
        if total is None:
            total = parent
        else:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("root"))
            total = total.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return written(total, f"{name}-components")
