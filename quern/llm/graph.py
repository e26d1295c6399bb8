"""Connected components of an edge table, without gathering a component in one task.

Each round contracts every partition by a local union-find (spanning forests only), then applies a
large-star and a small-star step; both move edges towards the smallest node of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow

#: Edges that one local union-find holds at a time.
FOREST_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes that aren't the smallest, by numpy label propagation with pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        open_ = low != high
        if not open_.any():
            break
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= FOREST_EDGES:
            v, m = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
            if 2 * len(v) > FOREST_EDGES:
                yield {"v": v, "m": m}
            else:
                held, size = [(v, m)], len(v)
    if held:
        v, m = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield {"v": v, "m": m}


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, m) for each node v of a component whose smallest node is m, v itself not the smallest.

    edges: two long columns, no nulls; repeated edges and loops are allowed.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("v"), F.col(b).alias("m"))
    for i in range(200):
        # read from a table, so many small files make one partition, and its forest is final where all edges fit in
        star = scratch.table(map_arrow(now, _contract, "v long, m long"), f"{name}_{i}")
        if i:
            scratch.drop(f"{name}_{i - 1}", f"{name}_{i - 1}a", f"{name}_{i - 1}b", f"{name}_{i - 1}c", f"{name}_{i - 1}d")
        stats = star.agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).first()
        if stats.n == stats.d and star.join(star.select(F.col("v").alias("m")), "m", "left_semi").isEmpty():
            return star
        both = star.union(star.select("m", "v"))
        low = scratch.table(both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low")), f"{name}_{i}a")
        large = both.filter("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).filter("v != m")
        large = scratch.table(large.distinct(), f"{name}_{i}b")
        least = scratch.table(large.groupBy("v").agg(F.min("m").alias("low")), f"{name}_{i}c")
        small = large.join(least, "v").select("v", "m", "low")
        small = small.select(F.explode(F.array(F.struct(F.col("v"), F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.*").filter("v != m")
        now = scratch.table(small.distinct(), f"{name}_{i}d")
    raise RuntimeError("the components didn't settle")
