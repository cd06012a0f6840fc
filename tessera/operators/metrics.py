"""Statistics of columns, of pair labels and of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LABEL_NAMES, label_name, ratio

#: ranges of values over which running counts are taken
RANGES = 64

# ---- columns -------------------------------------------------------------------------------------


def spread(value: Column, name: str) -> list[Column]:
    """A1. Mean and population deviation; null of nothing."""
    return [F.avg(value).alias(f"{name}_avg"), F.stddev_pop(value).alias(f"{name}_stdev")]


def counted_spread(rows: DataFrame, value: str, count: str, name: str) -> DataFrame:
    """A1 of values that occur ``count`` times each, as one row."""
    n, held = F.sum(F.when(F.col(value).isNotNull(), F.col(count))), rows.select(value, count)
    mean = held.agg(ratio(F.sum(F.col(value) * F.col(count)), n).alias(f"{name}_avg"))
    off = (F.col(value) - F.col(f"{name}_avg")) * (F.col(value) - F.col(f"{name}_avg"))
    return held.join(F.broadcast(mean)).agg(F.first(f"{name}_avg").alias(f"{name}_avg"), F.sqrt(ratio(F.sum(off * F.col(count)), n)).alias(f"{name}_stdev"))


def quartiles(value: Column) -> Column:
    """Exact quartiles with linear interpolation, as an array."""
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def median(value: Column) -> Column:
    """A2."""
    return F.percentile(value, F.lit(0.5))


def interquartile(value: Column) -> Column:
    """A2."""
    return F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))


def distinct_ratio(n: Column, of: Column) -> Column:
    return ratio(n, of)


def auc(df: DataFrame, value: str = "value", positive: str = "positive", by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """A18. ``auc``: the chance that a positive's value is above a negative's, ties half; null if a side is empty. count: how often
    a row occurs (once).

    By ranks instead of pairs, over distinct values with their counts, so ties and hot values are one row each.
    Running counts go over ranges of values between sampled quantiles, then over one row a range, so no task
    holds all values.
    """
    groups = list(by)
    times = F.lit(1).cast("long") if count is None else F.col(count)
    counted = df.filter(F.col(value).isNotNull() & F.col(positive).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.sum(F.when(F.col(positive), times).otherwise(0)).alias("__p"), F.sum(F.when(~F.col(positive), times).otherwise(0)).alias("__n"))
    marks = F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], 1000).alias("__marks")
    # without groups the marks and ranges are a few rows; with groups they are as many as those, and joined as Spark sees fit
    ranged = (counted.join(counted.groupBy(*groups).agg(marks), groups) if groups else counted.join(F.broadcast(counted.agg(marks)))).withColumn("__range", F.size(F.filter("__marks", lambda m: m < F.col("__v")))).drop("__marks")
    before = lambda *keys: Window.partitionBy(*groups, *keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*groups, "__range").agg(F.sum("__n").alias("__held"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__held").over(before().orderBy("__range")), F.lit(0))).drop("__held")
    local = F.coalesce(F.sum("__n").over(before("__range").orderBy("__v")), F.lit(0))
    scored = ranged.withColumn("__local", local).join(base if groups else F.broadcast(base), [*groups, "__range"]).withColumn("__w", F.col("__p") * (F.col("__base") + F.col("__local") + F.col("__n") / 2))
    made = ratio(F.sum("__w"), F.sum("__p").cast("double") * F.sum("__n")).alias("auc")
    return scored.groupBy(*groups).agg(made) if groups else scored.agg(made)


def separability(auc_: Column) -> Column:
    """A19. Distance of an AUC from chance, doubled."""
    return F.abs(2 * auc_ - 1)


def oriented(auc_: Column) -> Column:
    """A19. An AUC whichever way round is better."""
    return F.greatest(auc_, 1 - auc_)


# ---- labelled pairs ------------------------------------------------------------------------------


def class_metrics(labels: DataFrame, n_records: Column) -> DataFrame:
    """A4, A5. Counts by label, the comparison space, and their ratios; ``labels`` has the positive pairs, n_records is a literal."""
    counts = labels.agg(F.count_if(F.col("label") == 1).alias("n_label1"), F.count_if(F.col("label") == 2).alias("n_label2"))
    n = n_records.cast("long")
    space = F.floor(n * (n - 1) / 2).cast("long")
    positive = F.col("n_label1") + F.col("n_label2")
    return counts.select(
        "n_label1", "n_label2", positive.alias("n_positive"), space.alias("n_space"), (space - positive).alias("n_label0"),
        ratio(positive, space).alias("positive_rate"), ratio(space - positive, positive).alias("imbalance"), ratio(F.col("n_label1"), F.col("n_label2")).alias("match_bridge_ratio"),
    )


def unordered(left: str = "left", right: str = "right") -> list[Column]:
    """U4. A pair's ends, the smaller first."""
    return [F.least(left, right).alias("left"), F.greatest(left, right).alias("right")]


def pair_quality(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """A21. Precision, recall and F1 over unordered pairs."""
    p, t = predicted.select(*unordered()).distinct(), true.select(*unordered()).distinct()
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["left", "right"], "full_outer")
    counts = both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.select(zero(ratio(F.col("tp"), F.col("np"))).alias("precision"), zero(ratio(F.col("tp"), F.col("nt"))).alias("recall"), zero(ratio(2 * F.col("tp"), F.col("np") + F.col("nt"))).alias("f1"))


def confusion(rows: DataFrame, true: str = "true_label", predicted: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """A20. Counts over the full grid of 0 and the true labels; predictions outside it fall away."""
    labels = rows.select(F.col(true).cast("int").alias("label")).distinct().unionByName(rows.sparkSession.range(1).select(F.lit(0).alias("label"))).distinct()
    sides = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = sides.join(F.broadcast(labels.select(F.col("label").alias(true)))).join(F.broadcast(labels.select(F.col("label").alias(predicted))))
    counted = rows.groupBy(*by, F.col(true).cast("int").alias(true), F.col(predicted).cast("int").alias(predicted)).agg(F.count("*").alias("n"))
    return grid.join(counted, [*by, true, predicted], "left").select(*by, label_name(F.col(true)).alias("true_label"), label_name(F.col(predicted)).alias("pred_label"), F.coalesce("n", F.lit(0)).alias("count"))


def matthews(rows: DataFrame, true: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """A22. Multi-class Matthews correlation; 0 where it is not defined."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    marks = cells.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("a"), F.lit(0.0).alias("b")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("a"), F.col("n").alias("b")))).alias("m"))
    sums = marks.groupBy("m.k").agg(F.sum("m.a").alias("a"), F.sum("m.b").alias("b")).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    whole = cells.agg(F.sum("n").alias("s"), F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("n"))), F.lit(0.0)).alias("c"))
    s, c = F.col("s"), F.col("c")
    below = F.sqrt((s * s - F.col("bb")) * (s * s - F.col("aa")))
    return whole.join(F.broadcast(sums)).select(F.coalesce(F.try_divide(c * s - F.col("ab"), below), F.lit(0.0)).alias("mcc"))


def binary_quality(rows: DataFrame, true: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 of 0/1 labels."""
    t, p = F.col(true) == 1, F.col(predicted) == 1
    counts = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(p).alias("np"), F.count_if(t).alias("nt"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.select(zero(ratio(F.col("tp"), F.col("np"))).alias("precision"), zero(ratio(F.col("tp"), F.col("nt"))).alias("recall"), zero(ratio(2 * F.col("tp"), F.col("np") + F.col("nt"))).alias("f1"))


# ---- clusterings ---------------------------------------------------------------------------------


def contingency(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """J11. (t, p, n): members that a true and a predicted cluster share."""
    a, b = true.select("ref", F.col("cluster_id").alias("t")), predicted.select("ref", F.col("cluster_id").alias("p"))
    return a.join(b, "ref").groupBy("t", "p").agg(F.count("*").alias("n"))


def _choose2(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def cluster_quality(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """A23, E1 to E4, in one pass over the contingency table.

    pp, pr, pc: precision, recall and harmonic mean of pairs; cp, cr, cc: of exact clusters; ari: adjusted Rand
    index; twi: Talburt-Wang index.
    """
    cells = contingency(true, predicted)
    cells = cells.withColumns({"nt": F.sum("n").over(Window.partitionBy("t")), "np": F.sum("n").over(Window.partitionBy("p"))})
    share = lambda total: _choose2(F.col(total)) * F.col("n") / F.col(total)  # each cell's part of its cluster's pairs
    part = lambda total: F.col("n").cast("double") / F.col(total)
    sums = cells.agg(
        F.sum(_choose2(F.col("n"))).alias("tp"), F.round(F.sum(share("nt")), 6).alias("true"), F.round(F.sum(share("np")), 6).alias("pred"), F.sum("n").alias("n"),
        F.count_if((F.col("n") == F.col("nt")) & (F.col("n") == F.col("np"))).alias("same"), F.count("*").alias("cells"),
        F.round(F.sum(part("nt")), 6).alias("clusters_t"), F.round(F.sum(part("np")), 6).alias("clusters_p"),
    )
    tp, true_, pred = F.col("tp"), F.col("true"), F.col("pred")
    expected = true_ * pred / F.nullif(_choose2(F.col("n")), F.lit(0.0))
    harmonic = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    pp, pr = F.coalesce(F.try_divide(tp, pred), F.lit(0.0)), F.coalesce(F.try_divide(tp, true_), F.lit(0.0))
    cp, cr = F.coalesce(F.try_divide(F.col("same"), F.col("clusters_p")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("same"), F.col("clusters_t")), F.lit(0.0))
    rand = F.coalesce(F.try_divide(tp - expected, (true_ + pred) / 2 - expected), F.lit(1.0))
    return sums.select(pp.alias("pp"), pr.alias("pr"), harmonic(pp, pr).alias("pc"), cp.alias("cp"), cr.alias("cr"), harmonic(cp, cr).alias("cc"), rand.alias("ari"), F.try_divide(F.sqrt(F.col("clusters_t") * F.col("clusters_p")), F.col("cells")).alias("twi"))


def best_cluster_matches(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """V2. (t, p, n): one-to-one matches of clusters of two and more with the largest total overlap.

    Assignments of different connected parts of the overlap table do not touch each other, so each part is
    assigned alone, in one group.
    """
    from .components import connected_components

    several = lambda c: c.join(c.groupBy("cluster_id").agg(F.count("*").alias("size")).filter("size > 1"), "cluster_id")
    cells = contingency(several(true), several(predicted))
    named = cells.withColumns({"u": F.concat(F.lit("t"), F.col("t").cast("string")), "v": F.concat(F.lit("p"), F.col("p").cast("string"))})
    parts = connected_components(named, "u", "v").select(F.col("node").alias("u"), F.col("component").alias("part"))
    return named.join(parts, "u").select("part", "t", "p", "n").groupBy("part").applyInPandas(_assign, "t long, p long, n long")


def _assign(group):
    """Assignment with the largest sum by shortest augmenting paths."""
    import numpy as np
    import pandas as pd

    rows, columns = sorted(group["t"].unique()), sorted(group["p"].unique())
    cost = np.zeros((len(rows), len(columns)))
    at = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(columns)}
    for t, p, n in zip(group["t"], group["p"], group["n"], strict=True):
        cost[at[0][t], at[1][p]] = -n
    flipped = cost.shape[0] > cost.shape[1]
    cost = cost.T if flipped else cost
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            slack = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nearest = int(free.argmin())
            step = free[nearest]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nearest
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    found = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(c, r) if flipped else (r, c) for r, c in found]
    out = [(rows[r], columns[c], int(-(cost.T if flipped else cost)[r, c])) for r, c in pairs]
    return pd.DataFrame([x for x in out if x[2] > 0], columns=["t", "p", "n"])


LABELS = tuple(LABEL_NAMES)
