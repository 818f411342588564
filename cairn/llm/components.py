"""Connected components of a table of links, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut_lineage

# Links that a task joins at a time, and the size of its share.
LOCAL = 1 << 16


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) of every other node of each component of a bounded number of links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x, above in enumerate(parent):  # a parent is never behind its node
        parent[x] = parent[above]
    root = np.array(parent, np.int64)
    other = np.flatnonzero(root != np.arange(len(root)))
    return nodes[root[other]], nodes[other]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the same components, at most one for each node of ``LOCAL`` links."""
    held: list[np.ndarray] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, LOCAL):
            held.append(np.stack([batch.column(c).slice(lo, LOCAL).to_numpy() for c in ("a", "b")]))
            if sum(h.shape[1] for h in held) >= LOCAL:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _star(*np.concatenate(held, axis=1))], names=["a", "b"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _star(*np.concatenate(held, axis=1))], names=["a", "b"])


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """node, label of every node in a link; the label is the smallest node of its component.

    Links are first joined within shares of about ``LOCAL``, which leaves at most one
    link a node of each share.  Then each round gives a node the smallest label among
    itself and its neighbours and follows that label to its own label.  Following halves
    the way to the smallest node, so rounds grow with the logarithm of the longest chain.
    """
    links = cut_lineage(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    shares = max(1, -(-links.count() // LOCAL))
    stars = cut_lineage(links.coalesce(shares).mapInArrow(_stars, "a long, b long"))
    both = cut_lineage(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(shares))
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("other")).select(F.col("a").alias("node"), F.least("a", "other").alias("label")).coalesce(shares))
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        new = cut_lineage(met.join(roots, F.col("step") == F.col("root"), "left").select("node", "old", F.least("step", F.coalesce("root_label", "step")).alias("label")).coalesce(shares))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
