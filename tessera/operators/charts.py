"""Tables that charts are drawn from: places of nodes and clusters (V4), edges between them and their colours (V5, K14).

Nothing is drawn here. Places are computed in Spark: members on a spiral around their cluster's centre, clusters in shelves
from the largest down, so that circles don't overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .numbering import number_rows

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
#: space around a cluster, in units of a node
MARGIN = 1.0


def spiral(clusters: DataFrame) -> DataFrame:
    """V4. (ref, cluster_id, dx, dy): members around their cluster's centre, the first in it; a cluster of n fits a circle of radius sqrt(n)."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("ref")) - 1
    far, turn = F.sqrt(F.col("k").cast("double")), F.col("k") * GOLDEN_ANGLE
    return clusters.select("ref", "cluster_id").withColumn("k", place).select("ref", "cluster_id", (far * F.cos(turn)).alias("dx"), (far * F.sin(turn)).alias("dy"))


def shelves(clusters: DataFrame) -> DataFrame:
    """V4. (cluster_id, size, radius, x, y): centres of clusters, the largest first, shelf by shelf from the left.

    A shelf holds as many clusters as fit its width at the size of the shelf's first one, which is its largest.
    Numbers go over ranges; what is in one window is a row a shelf.
    """
    sized = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("ref").alias("first"))
    ranked = number_rows(sized, [F.desc("size"), F.col("first")], "n").withColumn("radius", F.sqrt(F.col("size").cast("double")) + MARGIN)
    n, most = ranked.agg(F.count("*"), F.max("radius")).first()
    across = max(1, math.isqrt(n or 1))
    placed = ranked.withColumns({"shelf": F.expr(f"(n - 1) div {across}"), "slot": (F.col("n") - 1) % across})
    heights = placed.groupBy("shelf").agg((2 * F.max("radius")).alias("height"))
    below = F.coalesce(F.sum("height").over(Window.orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tops = heights.select("shelf", "height", below.alias("below"))
    return placed.join(tops, "shelf").select("cluster_id", "size", "radius", ((F.col("slot") + 0.5) * F.col("height")).alias("x"), (F.col("below") + F.col("height") / 2).alias("y"))


def cluster_places(clusters: DataFrame) -> DataFrame:
    """V4. (ref, cluster_id, x, y) of all members."""
    return spiral(clusters).join(shelves(clusters), "cluster_id").select("ref", "cluster_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def graph_places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V4. (ref, cluster_id, x, y) of a graph's nodes: connected parts side by side."""
    found = connected_components(edges, "src", "dst")
    parts = nodes.select("ref").join(found, F.col("ref") == F.col("node"), "left").select("ref", F.coalesce("component", "ref").alias("cluster_id"))
    return cluster_places(parts)


# fixed values: colours of true positive, false positive and false negative edges
COLOURS = {"TP": "green", "FP": "red", "FN": "orange"}


def edge_lines(classified: DataFrame, places: DataFrame) -> DataFrame:
    """V5. (left, right, status, colour, x1, y1, x2, y2): classified edges as lines between placed nodes."""
    end = lambda side, k: places.select(F.col("ref").alias(side), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    colour = F.element_at(F.create_map(*[F.lit(v) for pair in COLOURS.items() for v in pair]), F.col("status"))
    return classified.join(end("left", 1), "left").join(end("right", 2), "right").select("left", "right", "status", colour.alias("colour"), "x1", "y1", "x2", "y2")


def sweep_lines(rows: DataFrame, x: str, columns: list[str], by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """K14. (by, series, x, y): the columns of a sweep as series of points, in long form; missing points are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("y")) for c in columns])
    return rows.select(*by, F.col(x).alias("x"), F.explode(pairs).alias("p")).select(*by, "p.series", "x", "p.y").filter("y IS NOT NULL")
