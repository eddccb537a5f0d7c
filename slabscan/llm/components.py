"""Connected components of a distributed edge table.

Edges are contracted first: each task takes about ``EDGES`` of them and leaves
one edge from every node to the smallest node of its component there.  What
the tasks leave is joined by alternating large and small stars; a table that
fits one task is done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import scratch, stored, tidy

#: Edges that a task contracts at once.
EDGES = 1 << 20


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component under the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        last = root.copy()
        # The roots of both ends are joined, not only the ends.
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = np.minimum(root, root[root])
        if (root == last).all():
            break
    return root


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v): each node but the smallest of its component among a task's edges, and that smallest one."""

    def run(batches):
        held, number = [], 0
        for batch in batches:
            held.append(batch)
            number += len(batch)
            if number >= 2 * EDGES:
                held = [solve(held)]
                number = len(held[0])
        if held:
            yield solve(held)

    def solve(held):
        u, v = (pa.chunked_array([b.column(i) for b in held]) for i in (0, 1))
        nodes = pc.unique(pa.chunked_array([*u.chunks, *v.chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        root = roots(len(nodes), *(np.asarray(pc.index_in(x, value_set=nodes).combine_chunks()) for x in (u, v)))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(other)), nodes.take(pa.array(root[other]))], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(tidy(run), edges.schema)


def _star(pairs: DataFrame) -> DataFrame:
    """Each row (x, y) with ``low``: the smallest of x and all its y.

    The minima are aggregated before they shuffle and then written, so a hub's
    many rows meet one row in a join that can be split where it is skewed.
    """
    low = stored(pairs.groupBy("x").agg(F.min("y").alias("low")))
    return pairs.join(low.hint("merge"), "x").select("x", "y", F.least("x", "low").alias("low"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, edges_per_task: int = EDGES) -> DataFrame:
    """(node, component) of every node that has an edge to another one; the component is its smallest node.

    Null ends, loops and repeated edges are left out.  Each round writes its
    edges to the shared folder, so lineage stays short; the number of rounds
    grows with the logarithm of the longest path.
    """
    with scratch(edges.sparkSession) as keep:
        given = stored(edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
        parts = max(1, -(-given.count() // edges_per_task))
        now = stored(_contracted(given, parts))
        mark = _mark(now) if parts > 1 else (0,)
        for _ in range(max_rounds):
            if mark[0] == 0:
                break
            with scratch(edges.sparkSession) as keep_step:
                now = _round(now)
                keep_step(now)
            last, mark = mark, _mark(now)
            if mark == last:
                break
        else:
            raise RuntimeError("components did not settle")
        keep(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _round(now: DataFrame) -> DataFrame:
    both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
    large = _star(both).where("y > x and y != low").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()
    small = _star(large.select(F.col("u").alias("x"), F.col("v").alias("y")))
    ends = F.explode(F.array("x", "y")).alias("u")
    return stored(small.select(ends, F.col("low").alias("v")).where("u != v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
