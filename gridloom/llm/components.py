"""Connected components of large graphs: minimum labels by alternating large and small stars.

Each round is two shuffles of the edges. Partitions first replace their edges by a
spanning forest of stars (union-find on a bounded block), so a dense group sends a
linear number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.frames import attach
from gridloom.session import ship, store

BLOCK_EDGES = 1 << 20


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges but the smallest ones."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (after := new[new]).tolist() != new.tolist():
            new = after
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node, low = local_stars(table["u"].to_numpy(), table["v"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_EDGES:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long, without nulls) but the smallest ones.

    A node's component is the smallest node reachable; nodes that are missing are their own
    component. Rounds go on until a forest of at most BLOCK_EDGES edges is left, which one
    task finishes, or nothing changes; ``max_rounds`` raises rather than give half a result.
    """
    ship(edges.sparkSession)
    pairs = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = store(pairs.mapInArrow(_contract, "u long, v long"), "edges")  # u > v
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= BLOCK_EDGES:
            now = now.repartition(1).mapInArrow(_contract, "u long, v long")
        if mark[0] <= BLOCK_EDGES or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to u's smallest neighbour (or u).
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count(F.lit(1)).alias("n"))
        large = attach(both.where("v > u"), lows, ["u"], [F.col("v")], "inner", "n").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: u and its smaller neighbours go to the smallest of them.
        mins = large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
        small = attach(large, mins, ["u"], [F.col("v")], "inner", "n").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").unionAll(mins.select("u", F.col("low").alias("v")))
        now = store(small.distinct().mapInArrow(_contract, "u long, v long"), "edges")
    raise RuntimeError("components did not settle")
