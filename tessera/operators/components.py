"""Connected components of an edge table (operator G8), by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at the least node it
sees, until nothing moves; the number of rounds grows with the logarithm of the longest chain. A
round is two aggregations with partial sums and two joins, so no task holds the neighbours of a
hub, and its result is cut off by a checkpoint in the shared folder. Edges that are counted and found to be no
more than ``FEW_EDGES`` are settled by one task instead, which spares the rounds; the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..runtime import checkpoint

#: edges that one task may hold, of numbers or texts
FEW_EDGES = 1 << 20


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settle(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, nodes being 0 to n - 1."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        both = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks()
        nodes = both.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        place = pc.index_in(both, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        label = _settle(place[: table.num_rows], place[table.num_rows :], len(nodes))
        yield from pa.table({"node": nodes, "component": nodes.take(pa.array(label))}).to_batches(max_chunksize=1 << 16)

    return edges.coalesce(1).mapInArrow(settle, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on an edge; the component is its least node.

    Null ends and loops are dropped; isolated nodes are not in the result.
    """
    held = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    held = checkpoint(held.filter("u <> v").distinct())
    state = _state(held)
    if state[0] <= FEW_EDGES and isinstance(held.schema["u"].dataType, IntegralType | StringType):
        return checkpoint(_in_one_task(held))
    while True:
        held = checkpoint(_small_star(_large_star(held)))
        before, state = state, _state(held)
        if before == state:
            break
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
