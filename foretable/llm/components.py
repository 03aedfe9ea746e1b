"""Connected components of a graph whose edges are a table, for graphs of any size.

Edges are first contracted within each partition by union-find, which leaves a forest of at most as many edges as
nodes. Then rounds of two steps run until the forest's trees are stars: each node's smaller neighbours and itself are
linked to the least of them (small star), then its larger neighbours to its least neighbour (large star). Rounds grow
with the logarithm of the node count; a graph of stars whose centres are the least nodes takes none. A node with very
many neighbours costs no long task: minima combine before the exchange and are stored, so that the joins' two sides are
both exchanged for the join and adaptive execution splits a hot node. Every step's edges are written to the shared
folder; neither edges nor components reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretable.llm.common import Scratch, ship

MOST_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (a := root(a)) != (b := root(b)):
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 10_000):
        some = [x for x in nodes[i : i + 10_000] if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind.field(0).type), pa.array(map(root, some), kind.field(0).type)], schema=kind)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one smaller node at most, and none to a node that is itself linked to a smaller one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge (two columns of one type, in any direction); component is the least
    node that can be reached. Edges with a null end and from a node to itself add nothing. The result is the table name
    of scratch; the steps before it are dropped."""
    ship(edges.sparkSession)
    edges = edges.toDF("a", "b").where("a <> b")
    now = scratch.store(edges.mapInArrow(_forest, edges.schema).distinct(), f"{name}-0")
    k = 0
    while not _all_stars(now):
        if (k := k + 1) > MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        down = scratch.store(now.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down-{k}")
        small = now.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        small = scratch.store(small.distinct(), f"{name}-small-{k}")
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least-{k}")
        now = scratch.store(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", *(f"{name}-{step}-{k}" for step in ("down", "small", "least")))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = scratch.store(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), name)
    scratch.drop(f"{name}-{k}")
    return out
