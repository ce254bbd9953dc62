"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, durable

#: Edges that one task joins by itself, some MB; a graph of more goes through rounds until the same number is left, or the end.
IN_ONE_TASK = 1 << 18


def _star(sym: DataFrame) -> DataFrame:
    """Each (u, v) of a symmetric edge list with m, the least of u and its neighbours."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(least, "u")


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches: every node points at the least one known, and pointers are followed."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            of = held[0]["u"].type
            u, v = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
            if len(u):
                yield pa.record_batch([pa.array(x, of) for x in _joined(u, v)], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component: the least node reachable, for every node of ``edges`` (u, v of one ordered type).

    Each round hangs neighbours on the least node known nearby and is written to the shared folder; rounds end when the
    edges no longer change, after about the logarithm of the longest chain, or are so few that one task can join them. Null
    ends, loops and repeats do no harm.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] <= IN_ONE_TASK:
            return _in_one_task(now)
        if (found["n"], found["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (found["n"], found["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)  # every u is larger than its v, so these are the neighbours that are smaller
        hung = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = durable(hung, name)
        discard(now)
        now = new
