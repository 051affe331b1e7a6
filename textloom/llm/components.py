"""Connected components: edges contracted in parts, then alternating large-star and small-star rounds.

Parts of at most ``PART`` edges are each replaced by stars around their components'
least nodes.  Edges that fit in one part are finished by that; others go through
rounds, each an aggregation and equi-joins on edges.  Minima are combined before they
are shuffled; the joins are plain sort-merge joins whose larger partitions
adaptive execution splits, so a hub's edges don't stay in one task.  Rounds end
when the edges no longer change and are checkpointed.  Edges come and go as (u long, v long);
nulls are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

#: Edges of a part, 16 bytes each.
PART = 250_000


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("low"))
    mine = low.select("u", F.col("low").alias("v"))
    rest = e.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return mine.union(rest).distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node and the least node of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(low, low[low]):
            low = low[low]
    return nodes, nodes[low]


def _contracted(e: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, low = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
            node, low = node[node != low], low[node != low]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["u", "v"])

    return C.checkpoint(e.repartition(parts).mapInArrow(C.trimmed(run), "u long, v long"))


def components(edges: DataFrame, max_rounds: int = 50, part: int = PART) -> DataFrame:
    """(node, component) of every node that an edge touches; the component is its smallest node."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = C.checkpoint(e)
    parts = -(-e.count() // part)
    e = _contracted(e, max(parts, 1))
    before = None
    for _ in range(max_rounds if parts > 1 else 0):
        e = C.checkpoint(_small(_large(e)))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
