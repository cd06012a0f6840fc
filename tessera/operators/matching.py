"""Matchers over comparisons, input orders, results and how they are evaluated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FULL_FEATURES, overlap_features, record_tokens
from ..runtime import checkpoint
from .graphs import degrade_results, match_graph, predicted_label, reciprocal
from .metrics import confusion, matthews, pair_quality
from .numbering import first_by_hash

#: A matcher adds ``label`` and ``label_weights`` to rows with record structs ``a`` and ``b``.
Matcher = Callable[[DataFrame], DataFrame]
NORMAL, REVERSE, BOTH = "normal", "reverse", "both"
ORDERS = (NORMAL, REVERSE, BOTH)


def coverage_matcher(fields: Sequence[str], match: float = 0.5, one_way: float = 0.8) -> Matcher:
    """A matcher that knows the order: by how much of each record's tokens the other one covers.

    Both above ``match``: 1; only the left one covered above ``one_way``: 2; else 0.
    """

    def run(rows: DataFrame) -> DataFrame:
        tokens = lambda side: record_tokens([F.col(f"{side}.{f}") for f in fields])
        held = rows.withColumns({"__a": tokens("a"), "__b": tokens("b")}).withColumn("__s", F.size(F.array_intersect("__a", "__b")))
        share = lambda c: F.coalesce(F.try_divide(F.col("__s").cast("double"), F.size(c).cast("double")), F.lit(0.0))
        ca, cb = share("__a"), share("__b")
        full, part = F.least(ca, cb), F.when(ca >= one_way, F.greatest(ca - cb, F.lit(0.0))).otherwise(F.lit(0.0))
        label = F.when(full >= match, 1).when(ca >= one_way, 2).otherwise(0)
        none = F.greatest(1 - full - part, F.lit(0.0))
        total = full + part + none
        return held.withColumns({"label": label, "label_weights": F.array(none / total, full / total, part / total)}).drop("__a", "__b", "__s")

    return run


def _surface(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``rows`` with the token features of each field, in one vector ``features``."""
    from pyspark.ml.feature import VectorAssembler

    made = {}
    for f in fields:
        found = overlap_features(record_tokens([F.col(f"a.{f}")]), record_tokens([F.col(f"b.{f}")]))
        made |= {f"__{f}_{k}": found[k].cast("double") for k in FULL_FEATURES}
    return VectorAssembler(inputCols=list(made), outputCol="features").transform(rows.withColumns(made)).drop(*made)


def fit_matcher(rows: DataFrame, fields: Sequence[str], classes: int = 3):
    """E10. A pipeline model over token features of pairs; rows: record structs ``a`` and ``b``, and a label below ``classes``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    learner = LogisticRegression(labelCol="label", family="multinomial", regParam=1e-3)
    model = Pipeline(stages=[learner]).fit(_surface(rows.withColumn("label", F.col("label").cast("double")), fields))
    if model.stages[0].numClasses > classes:
        raise ValueError(f"labels must lie below {classes}")
    return model


def model_matcher(model, fields: Sequence[str], classes: int = 3) -> Matcher:
    """E10. A matcher of a fitted Spark ML model: its prediction is the label, its probabilities the weights."""
    from pyspark.ml.functions import vector_to_array

    def run(rows: DataFrame) -> DataFrame:
        found = model.transform(_surface(rows, fields))
        weights = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), classes))
        return found.select(*rows.columns, F.col("prediction").cast("int").alias("label"), F.slice(weights, 1, classes).alias("label_weights"))

    return run


def orders_of(order: str) -> tuple[str, ...]:
    return (NORMAL, REVERSE) if order == BOTH else (order,)


def check_orders(orders: Sequence[str]) -> tuple[str, ...]:
    """At most three different input orders."""
    if unknown := set(orders) - set(ORDERS):
        raise ValueError(f"unknown input orders: {sorted(unknown)}")
    if len(set(orders)) != len(orders):
        raise ValueError("input orders must differ")
    return tuple(orders) or (NORMAL,)


def run_matcher(matcher: Matcher, comparisons: DataFrame, records: DataFrame, fields: Sequence[str], order: str = NORMAL) -> DataFrame:
    """J1. Results (call, seq, left, right, label, label_weights) of a matcher over comparisons in an input order.

    comparisons: seq, left, right. In both orders the second call's results follow all of the first's.
    """
    values = records.select("ref", F.struct(*fields).alias("r"))
    out = None
    for turn, call in enumerate(orders_of(order)):
        ends = ("left", "right") if call == NORMAL else ("right", "left")
        rows = comparisons.select("seq", F.col(ends[0]).alias("left"), F.col(ends[1]).alias("right"))
        rows = rows.join(values.select(F.col("ref").alias("left"), F.col("r").alias("a")), "left").join(values.select(F.col("ref").alias("right"), F.col("r").alias("b")), "right")
        found = matcher(rows).select(F.lit(call).alias("call"), F.struct(F.lit(turn).alias("turn"), "seq").alias("seq"), "left", "right", "label", "label_weights")
        out = found if out is None else out.unionByName(found)
    return out


def recorded_labels(results: DataFrame, comparisons: DataFrame, truth: DataFrame) -> DataFrame:
    """J2. A row for each comparison: the true label (0 if none), and the label of each call."""
    calls = results.withColumn("number", F.col("seq.seq")).groupBy("number").agg(*[F.max(F.when(F.col("call") == c, F.col("label"))).alias(c) for c in (NORMAL, REVERSE)])
    rows = comparisons.join(calls, F.col("seq") == F.col("number"), "left").join(truth.select("left", "right", F.col("label").alias("true")), ["left", "right"], "left")
    return rows.select("seq", "left", "right", F.coalesce("true", F.lit(0)).alias("true_label"), NORMAL, REVERSE)


def saved_results(results: DataFrame) -> DataFrame:
    """K11. As results are saved: labels that are not there are -1."""
    return results.fillna(-1, [c for c in (NORMAL, REVERSE) if c in results.columns])


def evaluate_matching(results: DataFrame, comparisons: DataFrame, truth: DataFrame, degrade: bool = False) -> tuple[DataFrame, DataFrame]:
    """P9, A21, A22. The graph, and its metrics: precision, recall and F1 for two classes, Matthews correlation for more."""
    graph = match_graph(results, degrade)
    two = degrade or results.agg(F.max(F.size("label_weights")).alias("n")).first()["n"] in (None, 2)
    if two:
        return graph, pair_quality(graph.select(F.col("src").alias("left"), F.col("dst").alias("right")), truth.filter("label > 0"))
    return graph, matthews(labelled_pairs(graph, comparisons, truth))


def labelled_pairs(graph: DataFrame, comparisons: DataFrame, truth: DataFrame) -> DataFrame:
    """(y_true, y_pred) of each comparison: the true label in its own order, the predicted one by the pair's edges."""
    both = reciprocal(graph)
    rows = comparisons.select("left", "right", F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r"))
    rows = rows.join(both.select(F.col("left").alias("l"), F.col("right").alias("r"), "forward", "back"), ["l", "r"], "left").join(truth.select("left", "right", F.col("label").alias("t")), ["left", "right"], "left")
    kept = F.col("left") == F.col("l")
    f, b = F.coalesce("forward", F.lit(0)), F.coalesce("back", F.lit(0))
    return rows.select(F.coalesce("t", F.lit(0)).alias("y_true"), predicted_label(F.when(kept, f).otherwise(b), F.when(kept, b).otherwise(f)).alias("y_pred"))


def confusion_of(recorded: DataFrame, order: str = NORMAL) -> DataFrame:
    """A20 over recorded labels."""
    return confusion(recorded.filter(F.col(order).isNotNull()).withColumnRenamed(order, "pred_label"))


def asymmetry(results: DataFrame) -> DataFrame:
    """A26. Rows where both calls ran: their labels, those labels' weights and the distance of the labels."""
    side = lambda call, name: results.filter(F.col("call") == call).select(F.col("seq.seq").alias("n"), "left", "right", F.col("label").alias(f"{name}_label"), F.element_at("label_weights", (F.col("label") + 1).cast("int")).alias(f"{name}_weight"))
    there, back = side(NORMAL, "xy"), side(REVERSE, "yx").drop("left", "right")
    return there.join(back, "n").select("left", "right", "xy_label", "yx_label", "xy_weight", "yx_weight", F.abs(F.col("xy_label") - F.col("yx_label")).alias("hamming"))


def comparison_space(truth: DataFrame, negatives: DataFrame, neg_pos_ratio: float = 4.0, match_bridge_ratio: float | None = None, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """E9. (left, right): positives, label-1 pairs held to a ratio of label-2 ones, and negatives to a ratio of positives, by a seeded hash.

    negatives: left, right; more than are wanted.
    """
    ends = ["left", "right"]
    first = lambda df, n: first_by_hash(checkpoint(df.select(*ends)), n, ends, seed)
    matches, bridged = truth.filter("label = 1"), truth.filter("label = 2")
    n2 = bridged.count()
    if match_bridge_ratio is not None and n2:
        matches = first(matches, round(match_bridge_ratio * n2))
    positives = matches.select(*ends).unionByName(bridged.select(*ends))
    space = positives.unionByName(first(negatives, round(neg_pos_ratio * positives.count())))
    return space if max_samples is None else first(space, max_samples)


def is_bridge(ref: Column, source: str) -> Column:
    """P6. By a configured source."""
    return ref["source"] == source


def check_source(records: DataFrame, source: str) -> None:
    """P8. A bridge source that no record has is an error."""
    if records.filter(F.col("ref.source") == source).limit(1).count() == 0:
        raise ValueError(f"no record comes from bridge source {source!r}")



