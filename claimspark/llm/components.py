"""Connected components of a graph that fits nowhere: alternating large and small stars, on edges that tasks have joined up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: Edges that a task joins up at once.
TASK_EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest that these edges lead it to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(*ends.reshape(2, -1).tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x, r in enumerate(root):  # a root is not larger, so its own is known
        root[x] = root[r]
    least = nodes[np.array(root, np.int64)]
    return nodes[nodes != least], least[nodes != least]


def joined_up(edges: DataFrame, tasks: int, task_edges: int) -> DataFrame:
    """Edges that connect the same nodes, at most one for a node in each ``task_edges`` that a task reads."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, task_edges):
                part = batch.slice(at, task_edges)
                if n + part.num_rows > task_edges:
                    yield joined(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield joined(held)

    def joined(held):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([*map(pa.array, stars(a, b))], ["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the edges ``a, b`` (longs, in any order).

    Tasks first join up the edges they read, ``task_edges`` at a time; where
    that is all of them, the stars are complete. Otherwise every round hangs
    each node's larger neighbours, then its smaller ones, on its smallest
    neighbour, and writes the edges to the shared folder; a logarithmic number
    of rounds leaves one star for each component. A node of any degree is only
    ever aggregated and joined there, never gathered. A round is many stages,
    and the driver keeps something of each of their tasks.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_shared(edges, "edges")
    state = _state(edges)
    while state[0]:
        tasks = -(-state[0] // task_edges)
        edges = write_shared(joined_up(edges, tasks, task_edges), "edges")
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write_shared(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        state, before = _state(edges), state
        if state == before:
            break
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres).distinct()
