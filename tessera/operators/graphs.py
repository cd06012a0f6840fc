"""Match graphs: edges of results, ground truth, differences and reciprocal edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import degrade as degraded
from ..runtime import shuffle_width
from .members import BLOCK_ROWS
from .metrics import unordered


def edge_labels(left: Column, right: Column, label: Column, classes: Column) -> Column:
    """F25. Edges that one result writes: none for 0; one for 1 of two classes; both ways for 1 of more; left to right for 2."""
    edge = lambda a, b, x: F.struct(a.alias("src"), b.alias("dst"), x.cast("int").alias("label"))
    forward, back = edge(left, right, label), edge(right, left, label)
    return F.when((label == 1) & (classes > 2), F.array(forward, back)).when(label.isin(1, 2), F.array(forward))


def match_graph(results: DataFrame, degrade: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, label, weight) of results (seq, left, right, label, label_weights): later edges replace earlier ones, a later 0 nothing.

    degrade: labels become binary, and each edge goes both ways.
    """
    label, weights = F.col("label"), F.col("label_weights")
    if degrade:
        label, weights = degraded(label, weights)
        edge = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1).alias("label"))
        made = F.when(label == 1, F.array(edge("left", "right"), edge("right", "left")))
    else:
        made = edge_labels(F.col("left"), F.col("right"), label, F.size("label_weights"))
    weight = F.element_at(weights, (label + 1).cast("int"))
    edges = results.select(*by, "seq", weight.alias("weight"), F.posexplode(made).alias("place", "e")).select(*by, "e.src", "e.dst", F.struct("seq", "place").alias("turn"), F.struct("e.label", "weight").alias("value"))
    return edges.groupBy(*by, "src", "dst").agg(F.max_by("value", "turn").alias("value")).select(*by, "src", "dst", "value.label", "value.weight")


def degrade_results(results: DataFrame) -> DataFrame:
    """F24 on rows of results."""
    label, weights = degraded(F.col("label"), F.col("label_weights"))
    return results.withColumns({"label": label, "label_weights": weights})


def reciprocal(edges: DataFrame) -> DataFrame:
    """J9. One row for each unordered pair with edges: labels forward (smaller end first) and back, 0 where there is none."""
    forward = F.max(F.when(F.col("src") < F.col("dst"), F.col("label")))
    back = F.max(F.when(F.col("src") >= F.col("dst"), F.col("label")))
    return edges.groupBy(*unordered("src", "dst")).agg(F.coalesce(forward, F.lit(0)).alias("forward"), F.coalesce(back, F.lit(0)).alias("back"))


def predicted_label(forward: Column, back: Column) -> Column:
    """Label of a pair by its edges: both ways 1, forward 2, back 3, none 0."""
    return F.when((forward > 0) & (back > 0), 1).when(forward > 0, 2).when(back > 0, 3).otherwise(0)


def classify_edges(predicted: DataFrame, true: DataFrame, ordered: bool = False) -> DataFrame:
    """V1. (left, right, status): true positive, false positive or false negative, of edges or of unordered pairs."""
    ends = (lambda e: e.select(F.col("src").alias("left"), F.col("dst").alias("right"))) if ordered else (lambda e: e.select(*unordered("src", "dst")))
    p, t = ends(predicted).distinct().withColumn("p", F.lit(True)), ends(true).distinct().withColumn("t", F.lit(True))
    status = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), "TP").when(F.col("p").isNotNull(), "FP").otherwise("FN")
    return p.join(t, ["left", "right"], "full_outer").select("left", "right", status.alias("status"))


def merge_reciprocal(classified: DataFrame) -> DataFrame:
    """V1. Ordered edges of one status as one row, ``both_ways`` where both directions have it."""
    return classified.groupBy(*unordered(), "status").agg((F.count("*") > 1).alias("both_ways"))


def status_counts(classified: DataFrame) -> DataFrame:
    """A24. Counts by status; an edge both ways counts twice when ordered."""
    return classified.groupBy("status").agg(F.count("*").alias("n"))


def ground_truth_edges(truth: DataFrame, max_label: int) -> DataFrame:
    """V3. Edges of the true graph: with labels up to 1 a match is one way, with 2 in use a match goes both ways."""
    classes = F.lit(max(max_label + 1, 2))
    return truth.select(F.explode(edge_labels(F.col("left"), F.col("right"), F.col("label"), classes)).alias("e")).select("e.src", "e.dst", "e.label")


def directed_truth(clusters: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """U2, G6. (left, right, label) from clusters with bridges and their seeds: pairs within clusters 1, (target, bridge) 2.

    clusters: ref, cluster_id, is_bridge; they are disjoint. seeds: bridge, linked. by: columns of both that tell variants apart.
    Bridges stand right, but for pairs of two.

    Each pair is made once and none is exchanged: members are numbered within their cluster, blocks are ranges of these numbers,
    and a member comes to a block with the numbers there that are linked with it, so a linked pair is left out where it is made.
    """
    group = F.struct(*by, "cluster_id").alias("group")
    members = clusters.filter("cluster_id IS NOT NULL").groupBy(group, "ref").agg(F.max("is_bridge").alias("is_bridge"))
    own = Window.partitionBy("group")
    held = members.select("group", "ref", "is_bridge", F.row_number().over(own.orderBy("ref")).alias("place"), F.count("*").over(own).alias("size"))
    block = lambda place: F.floor((F.col(place) - 1) / BLOCK_ROWS).cast("int")
    links = seeds.select(*by, "bridge", F.explode("linked").alias("ref")).distinct()
    homes = held.select(*[F.col(f"group.{c}").alias(c) for c in by], F.col("ref").alias("bridge"), "group", F.col("place").alias("right"))
    asked = links.join(homes, [*by, "bridge"]).select("group", "right", "ref")
    inner = asked.join(held.select("group", "ref", F.col("place").alias("left")), ["group", "ref"])
    linked = inner.groupBy("group", F.col("right").alias("place"), block("left").alias("other")).agg(F.collect_list("left").alias("linked"))
    every = F.explode(F.sequence(F.lit(0), block("size"))).alias("other")
    grid = held.select("group", "ref", "is_bridge", "place", block("place").alias("own"), every).join(linked, ["group", "place", "other"], "left")
    end = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("ref", "is_bridge", "place", "linked")]
    a = grid.filter("own <= other").select("group", F.col("own").alias("i"), F.col("other").alias("j"), *end("x"))
    b = grid.filter("other <= own").select("group", F.col("other").alias("i"), F.col("own").alias("j"), *end("y"))
    a, b = (x.repartition(shuffle_width(clusters.sparkSession), "group", "i", "j") for x in (a, b))  # few rows, but many pairs
    pairs = a.join(b.hint("merge"), ["group", "i", "j"]).filter("x_place < y_place")
    swap = F.col("x_is_bridge") & ~F.col("y_is_bridge")
    no_link = "(x_linked IS NULL AND y_linked IS NULL) OR NOT coalesce(IF(x_is_bridge AND NOT y_is_bridge, array_contains(x_linked, y_place), array_contains(y_linked, x_place)), false)"
    ends = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("y_ref", "x_ref", "left"), ("x_ref", "y_ref", "right"))]
    within = pairs.filter(no_link).select(*[f"group.{c}" for c in by], *ends, F.lit(1).alias("label"))
    across = links.select(*by, F.col("ref").alias("left"), F.col("bridge").alias("right"), F.lit(2).alias("label"))
    return within.unionByName(across)


def undirected_truth(directed: DataFrame) -> DataFrame:
    return directed.withColumn("label", F.lit(1))


def staleness(nodes: DataFrame, edges: DataFrame, refs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """S8. Counts of unexpected nodes, missing nodes and edges that no comparison asks for; a graph is stale unless all are 0."""
    asked = comparisons.select(*unordered()).distinct()
    found = edges.select(*unordered("src", "dst")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        count(nodes.select("ref").join(refs.select("ref"), "ref", "left_anti"), "unexpected_nodes")
        .join(F.broadcast(count(refs.select("ref").join(nodes.select("ref"), "ref", "left_anti"), "missing_nodes")))
        .join(F.broadcast(count(found.join(asked, ["left", "right"], "left_anti"), "unpaired_edges")))
    )


def pair_differences(saved: DataFrame, expected: DataFrame) -> DataFrame:
    """U3. Unordered pairs saved but not expected, and expected but not saved."""
    s, e = saved.select(*unordered()).distinct(), expected.select(*unordered()).distinct()
    return s.join(e, ["left", "right"], "left_anti").withColumn("side", F.lit("unexpected")).unionByName(e.join(s, ["left", "right"], "left_anti").withColumn("side", F.lit("missing")))


def without_pairs(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """S5, J7. Pairs that no excluded pair equals, whichever way round."""
    gone = excluded.select(*unordered()).distinct()
    return pairs.withColumns({"__l": F.least("left", "right"), "__r": F.greatest("left", "right")}).join(gone.toDF("__l", "__r"), ["__l", "__r"], "left_anti").select(pairs.columns)


def prediction_nodes(clusters: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """V6. Members with their true cluster, the true cluster their predicted one matches, and whether that is wrong;
    members alone in both are left out. ``matches``: (t, p)."""
    size = lambda c: F.count("*").over(Window.partitionBy(c))
    rows = clusters.select("ref", F.col("cluster_id").alias("t")).join(predicted.select("ref", F.col("cluster_id").alias("p")), "ref")
    rows = rows.withColumns({"nt": size("t"), "np": size("p")}).filter("NOT (nt = 1 AND np = 1)")
    named = rows.join(matches.select("p", F.col("t").alias("partner")), "p", "left")
    return named.select("ref", "t", "p", "partner", (~F.col("partner").eqNullSafe(F.col("t"))).alias("wrong"))
