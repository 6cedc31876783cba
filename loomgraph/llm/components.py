"""Connected components of an edge table: tasks make forests of their edges, then one task joins
those that are few, label propagation with pointer jumping those that are many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, trimmed

#: edges that a task has at a time: of its own, or of all tasks' forests
FEW = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, in order, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def forests(edges: DataFrame, names: tuple[str, str], most: int | None, every: bool = False) -> DataFrame:
    """Edges from nodes to the smallest of their component, among so many edges of a task at a time (None:
    all); with `every` from the smallest to themselves too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> pa.RecordBatch:
            nodes, root = roots(*(np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("a", "b")))
            keep = (nodes != root) | every
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], list(names))

        held, n = [], 0
        for batch in trimmed(batches):
            held.append(batch)
            n += batch.num_rows
            if most and n >= most:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    return edges.select("a", "b").mapInArrow(work, f"{names[0]} long, {names[1]} long")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges: a, b long.  Stored rows (id, label): every node that has an edge to another, with the
    smallest node of its component.  Up to FEW edges of the tasks' forests are joined by one task.  Above,
    nodes with many edges are summed before each shuffle; labels stay distributed, the driver sees
    one count a round."""
    edges = stored(forests(edges.filter("a <> b"), ("a", "b"), FEW), "forests")
    if edges.count() <= FEW:
        return stored(forests(edges.coalesce(1), ("id", "label"), None, every=True), "labels")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("id") == F.col("n")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("next"))
        new = stored(low.join(jump, "low").select("id", "old", F.least("low", "next").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
