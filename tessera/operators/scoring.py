"""Ambiguity scores of record pairs, and what clusters derive from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal, normal_bound, normal_similarity
from ..runtime import checkpoint, shuffle_width
from .members import member_pairs, pairs_of_likes
from .records import Fields

#: means are compared at this many decimals, as sums of parts come in any order
PLACES = 9
#: representatives on a side of a block of pairs
BLOCK_ROWS = 1024


NORMAL = "__normal_"


def field_score(a: Column, b: Column, *, text: bool, target: bool, null_is_absent: bool, bound: bool = False, normals: tuple[Column, Column] | None = None) -> Column:
    """One field's part of the ambiguity score (F7).

    Equal +2. Different texts: of a target +2 where one holds the other, else twice their edit similarity; else -0.5.
    Present on one side only: -0.5. Any other difference: -1. ``bound``: at least the score, without an edit distance.
    normals: both values lower-cased and stripped, where that is done once a value and not once a pair.
    """
    equal = F.when(a.eqNullSafe(b), F.lit(2.0))
    if null_is_absent:
        equal = F.when(a.isNull() & b.isNull(), F.lit(0.0)).when(a.isNull() | b.isNull(), F.lit(-0.5)).when(a == b, F.lit(2.0))
    if not text:
        return equal.otherwise(F.lit(-1.0))
    if not target:
        apart = F.lit(-0.5)
    else:
        x, y = normals or (normal(a), normal(b))
        similar = normal_bound(x, y) if bound else normal_similarity(x, y)
        apart = F.when(F.contains(x, y) | F.contains(y, x), F.lit(2.0)).otherwise(2.0 * similar)
    return equal.when(a.isNotNull() & b.isNotNull(), apart).otherwise(F.lit(-1.0))


def ambiguity(left: str, right: str, fields: Fields, bound: bool = False, normals: bool = False) -> Column:
    """F7. The score of two records, structs ``left`` and ``right``: the sum over all fields. normals: of ``record``."""

    def score(f: str) -> Column:
        sides = (F.col(f"{left}.{NORMAL}{f}"), F.col(f"{right}.{NORMAL}{f}")) if normals and f in fields.targets and f in fields.text else None
        return field_score(F.col(f"{left}.{f}"), F.col(f"{right}.{f}"), text=f in fields.text, target=f in fields.targets, null_is_absent=fields.null_is_absent, bound=bound, normals=sides)

    parts = [score(f) for f in fields.names]
    return sum(parts[1:], parts[0])


def record(fields: Fields) -> Column:
    """The fields of a record as one struct, with the target texts lower-cased and stripped."""
    return F.struct(*fields.names, *[normal(F.col(f)).alias(NORMAL + f) for f in fields.names if f in fields.targets and f in fields.text])


def at_places(score: Column, places: int = PLACES) -> Column:
    """``round`` of a score, halves away from zero, by arithmetic on doubles: cheap enough for every pair."""
    return F.signum(score) * F.floor(F.abs(score) * 10.0**places + 0.5) / 10.0**places


def score_pairs(pairs: DataFrame, records: DataFrame, fields: Fields, left: str = "left", right: str = "right") -> DataFrame:
    """J1 and F7. ``pairs`` with ``score``."""
    values = records.select("ref", record(fields).alias("__r"))
    a = values.select(F.col("ref").alias(left), F.col("__r").alias("__a"))
    b = values.select(F.col("ref").alias(right), F.col("__r").alias("__b"))
    return pairs.join(a, left).join(b, right).withColumn("score", ambiguity("__a", "__b", fields, normals=True)).drop("__a", "__b")


def mean_ambiguity(records: DataFrame, fields: Fields) -> DataFrame:
    """A13. (cluster_id, ref, size, mean): the mean score of each member against its mates, for clusters of more than one.

    Scores add up over fields. Where a field's score follows from equality alone, counts of its values and nulls give its sum.
    Texts of target fields are compared once for each two distinct values of a cluster rather than for each two
    members; a value's scores are weighted by how many members have the other.
    """
    compared = [f for f in fields.names if f in fields.text and f in fields.targets]
    filled = {f: F.count(f).alias(f"__filled_{f}") for f in fields.names if f not in compared}
    sizes = records.groupBy("cluster_id").agg(F.count("*").alias("size"), *filled.values()).filter("size > 1")
    held = records.join(sizes, "cluster_id")
    out, whole, self_score = held, F.lit(0.0), F.lit(0.0)
    for k, f in enumerate(fields.names):
        values = held.groupBy("cluster_id", F.col(f).alias("v")).agg(F.count("*").alias("n"))
        if f in compared:
            values = values.withColumn("x", normal(F.col("v")))
            pairs = member_pairs(values, "cluster_id", "v", {"v": "v", "x": "x"}, {"w": "v", "m": "n", "y": "x"})
            score = field_score(F.col("v"), F.col("w"), text=True, target=True, null_is_absent=fields.null_is_absent, normals=(F.col("x"), F.col("y")))
            by_value = pairs.groupBy("cluster_id", "v").agg(F.sum(score * F.col("m")).alias(f"__s{k}"))
            part = F.col(f"__s{k}")
        else:
            by_value = values.withColumnRenamed("n", f"__s{k}")
            n, some, all_ = F.col(f"__s{k}"), F.col(f"__filled_{f}"), F.col("size")
            apart, one_sided, both_null = -0.5 if f in fields.text else -1.0, -0.5 if fields.null_is_absent else -1.0, 0.0 if fields.null_is_absent else 2.0
            part = F.when(F.col(f).isNotNull(), 2.0 * n + apart * (some - n) + one_sided * (all_ - some)).otherwise(both_null * n + one_sided * some)
        by_value = by_value.select(F.col("cluster_id").alias("__c"), "v", f"__s{k}")
        out = out.join(by_value, (F.col("cluster_id") == F.col("__c")) & F.col(f).eqNullSafe(F.col("v"))).drop("__c", "v")
        whole = whole + part
        self_score = self_score + (F.when(F.col(f).isNull(), 0.0).otherwise(2.0) if fields.null_is_absent else F.lit(2.0))
    return out.select("cluster_id", "ref", "size", F.round((whole - self_score) / (F.col("size") - 1), PLACES).alias("mean"))


def rank_members(records: DataFrame, fields: Fields) -> DataFrame:
    """W2. (cluster_id, ref, rank, mean): the representative first (rank 0), the rest by mean score.

    The representative is the first member with the highest mean, or the first member if no mean is positive;
    equal means keep the order of refs.
    """
    single = records.groupBy("cluster_id").agg(F.count("*").alias("size"), F.first("ref").alias("ref")).filter("size = 1")
    rows = mean_ambiguity(records, fields).unionByName(single.select("cluster_id", "ref", "size", F.lit(0.0).alias("mean")))
    by_cluster = Window.partitionBy("cluster_id")
    positive = F.when(F.max("mean").over(by_cluster) > 0, -F.col("mean")).otherwise(F.lit(0.0))
    first = F.row_number().over(by_cluster.orderBy(positive, "ref")) == 1
    ordered = by_cluster.orderBy(F.desc("is_first"), F.desc("mean"), "ref")
    return rows.withColumn("is_first", first).withColumn("rank", (F.row_number().over(ordered) - 1).cast("int")).select("cluster_id", "ref", "rank", "mean")


def affinity(records: DataFrame, ranked: DataFrame, fields: Fields, links: int = 1, min_score: float | None = None, later_only: bool = False) -> DataFrame:
    """J4, A14, W3. (home, target, score): each cluster's representative against every other cluster.

    The score is the least over the target's first ``links`` members. Pairs are dealt out by a grid of blocks, a side of
    each holding about ``BLOCK_ROWS`` rows however many clusters there are, so a row is copied once for that many partners.
    With ``min_score`` pairs whose cheap bound stays below are dropped before any edit distance; ``later_only`` keeps
    targets after their home.
    """
    values = records.select("ref", record(fields).alias("r"))
    rows = checkpoint(ranked.filter(F.col("rank") < links).join(values, "ref").select("cluster_id", "rank", "r"))
    n_homes, n_targets = rows.agg(F.count_if(F.col("rank") == 0), F.count("*")).first()
    across, down = (max(1, -(-n // BLOCK_ROWS)) for n in (n_targets, n_homes))
    side = lambda n, seed: F.pmod(F.xxhash64("cluster_id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    homes = rows.filter("rank = 0").select(F.col("cluster_id").alias("home"), F.col("r").alias("a"), side(down, 0).alias("__row"), every(across).alias("__column"))
    targets = rows.select(F.col("cluster_id").alias("target"), F.col("r").alias("b"), side(across, 1).alias("__column"), every(down).alias("__row"))
    apart = F.col("target") > F.col("home") if later_only else F.col("target") != F.col("home")
    pairs = homes.join(targets, ["__row", "__column"]).filter(apart)
    if min_score is not None:
        pairs = pairs.filter(ambiguity("a", "b", fields, bound=True, normals=True) >= min_score)
    scored = pairs.select("home", "target", ambiguity("a", "b", fields, normals=True).alias("s")).groupBy("home", "target").agg(F.min("s").alias("score"), F.count("*").alias("__n"))
    if min_score is not None:  # a pair that lost a member to the bound is below the threshold as a whole
        expected = rows.groupBy(F.col("cluster_id").alias("target")).agg(F.count("*").alias("__all"))
        scored = scored.join(expected, "target").filter("__n = __all").drop("__all").filter(F.col("score") >= min_score)
    return scored.select("home", "target", F.round("score", PLACES).alias("score"))


def cluster_pairs(records: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """J3. All pairs (left, right) within clusters, left first; ``carried`` columns of both ends come along as left_ and right_.

    What is needed of the ends is copied with the members, so that nothing of the size of the pairs is exchanged for it.
    """
    side = lambda end: {end: "ref"} | {f"{end}_{c}": c for c in carried}
    return member_pairs(records.select("cluster_id", "ref", *carried), "cluster_id", "ref", side("left"), side("right")).filter("left < right")


def score_carried(pairs: DataFrame, fields: Fields) -> DataFrame:
    """F7 of pairs that carry ``values`` of both ends, each a ``record``: ``pairs`` with ``score`` instead of them."""
    return pairs.withColumn("score", ambiguity("left_values", "right_values", fields, normals=True)).drop("left_values", "right_values")


def scored_pairs(records: DataFrame, fields: Fields, kinds: Mapping[str, bool], alike: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """J3 with F7. (cluster_id, left, right) of all pairs within clusters, left first, and a score for each of ``kinds``, by whether it is a bound.

    Texts are compared once for two groups of members of a cluster that have the same ones, other values once a pair. ``alike``
    and ``carried`` columns of both ends come along as a_ and b_; groups have the same ``alike``. ``a`` may be either end.
    """
    texts = [f for f in fields.names if f in fields.text]
    targets = [f for f in texts if f in fields.targets]
    values = records.select("cluster_id", "ref", *fields.names, *alike, *carried, *[normal(F.col(f)).alias(NORMAL + f) for f in targets])
    ends = lambda f: (F.col(f"a_{f}"), F.col(f"b_{f}"))

    def score(f: str, bound: bool) -> Column:
        return field_score(*ends(f), text=f in texts, target=f in fields.targets, null_is_absent=fields.null_is_absent, bound=bound, normals=ends(NORMAL + f) if f in targets else None)

    settled = {f"__{kind}_{f}": score(f, bound) for kind, bound in kinds.items() for f in texts} | {x: F.col(x) for c in alike for x in (f"a_{c}", f"b_{c}")}
    rest = [f for f in fields.names if f not in texts]
    pairs = pairs_of_likes(values, "cluster_id", "ref", [*texts, *[NORMAL + f for f in targets], *alike], [*rest, *carried], settled, shuffle_width(records.sparkSession))
    part = lambda f, kind: F.col(f"__{kind}_{f}") if f in texts else score(f, kinds[kind])
    scores = [sum((part(f, kind) for f in fields.names[1:]), part(fields.names[0], kind)).alias(kind) for kind in kinds]
    return pairs.select("cluster_id", "left", "right", *scores, *[f"{e}_{c}" for c in (*alike, *carried) for e in "ab"])
