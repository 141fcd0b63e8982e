"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task contracts at a time.
TOGETHER = 1 << 18


def _larger_first(edges: DataFrame) -> DataFrame:
    a, b = edges.columns
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and for each the smallest one it reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[top]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def _in_few(links: DataFrame, count: int) -> DataFrame:
    """In as many tasks as about `count` links are worth: few ones do not take as many as a shuffle of the whole input."""
    return links.coalesce(max(links.sparkSession.sparkContext.defaultParallelism, -(-count // TOGETHER)))


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Links u > v, where those that a task holds together are replaced by one for each node, to the smallest it reaches.

    These connect what the others did.
    """

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, least = least_reachable(u, v)
        on = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(least[on])], names=["u", "v"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield stars(held)
                held, rows = [], 0
        if held:
            yield stars(held)

    longs = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    return _in_few(longs, count).mapInArrow(run, "u long,v long")


def _settled(edges: DataFrame) -> bool:
    """Whether each node's links, u > v, all lead to one node that leads no further."""
    end = lambda node, to: F.struct(F.col(node).alias("node"), to.alias("to"))
    ends = F.explode(F.array(end("u", F.col("v")), end("v", F.lit(None).cast("long"))))
    nodes = edges.select(ends.alias("end")).groupBy("end.node").agg(
        F.min("end.to").alias("least"), F.max("end.to").alias("most"), F.bool_or(F.col("end.to").isNull()).alias("led_to")
    )
    return not nodes.agg(F.count_if((F.col("least") != F.col("most")) | (F.col("least").isNotNull() & F.col("led_to")))).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Two columns of ids -> node, component (smallest id reachable) for every node with a link. Edges are read twice.

    Every round is written to the shared folder, so that the lineage stays short. A node's links are never
    gathered: minima are aggregates, and joins on a much linked node can be split.
    """
    count = edges.count()
    now = written(_contracted(_larger_first(edges), count))
    for _ in range(most_rounds):
        if _settled(now):
            break
        count = now.count()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("link")).select("link.*").where("u <> v").distinct()
        now = written(_contracted(small, count))
    else:
        if not _settled(now):
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return _in_few(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct(), count)
