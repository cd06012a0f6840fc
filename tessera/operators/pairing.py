"""Pairing clusters or records into bridge seeds: token blocking and greedy pairing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokens
from ..runtime import checkpoint
from .records import Fields
from .scoring import affinity, rank_members, score_pairs

SEPARATOR = "\x1f"
#: edges of open homes that one task settles
FEW_EDGES = 1 << 20
WEIGHT_PLACES = 12


# ---- token blocking (G1) -------------------------------------------------------------------------


def record_tokens(records: DataFrame, fields: Fields, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(ref, cluster_id, token) of the target fields."""
    found = F.array_distinct(F.flatten(F.array(*[tokens(F.col(f), stopwords) for f in sorted(fields.targets) if f in fields.text])))
    return records.select("ref", "cluster_id", F.explode(found).alias("token"))


def blocks(tokened: DataFrame, max_block_size: int = 100) -> DataFrame:
    """Tokens of 2 to ``max_block_size`` records, with their size; larger blocks go before any join."""
    return tokened.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_block_size))


def block_pairs(tokened: DataFrame, max_block_size: int = 100) -> DataFrame:
    """J5, A16. (left, right, left_cluster, right_cluster, weight): pairs of different clusters, left first; each shared block of n
    records adds ``2 / (n * (n - 1))``."""
    held = tokened.join(blocks(tokened, max_block_size), "token")
    a = held.select("token", "n", F.col("ref").alias("left"), F.col("cluster_id").alias("left_cluster"))
    b = held.select("token", F.col("ref").alias("right"), F.col("cluster_id").alias("right_cluster"))
    pairs = a.join(b, "token").filter("left < right AND left_cluster <> right_cluster")
    weight = F.round(F.sum(2 / (F.col("n") * (F.col("n") - 1))), WEIGHT_PLACES)
    return pairs.groupBy("left", "right", "left_cluster", "right_cluster").agg(weight.alias("weight"))


def top_partners(pairs: DataFrame, neighbours: int = 1) -> DataFrame:
    """W4. (ref, partner): each record's first partners by weight, then ref."""
    both = pairs.select(F.col("left").alias("ref"), F.col("right").alias("partner"), "weight").unionByName(pairs.select(F.col("right").alias("ref"), F.col("left").alias("partner"), "weight"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("weight"), "partner"))
    return both.withColumn("place", place).filter(F.col("place") <= neighbours).select("ref", "partner")


def token_blocking(records: DataFrame, fields: Fields, neighbours: int = 1, scope: str = "any", max_block_size: int = 100, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """G1. (home, target, home_cluster, target_cluster, weight): pairs that one side (``any``) or both (``mutual``) rank among their first."""
    if scope not in ("any", "mutual"):
        raise ValueError(f"unknown pairing scope: {scope}")
    pairs = block_pairs(record_tokens(records, fields, stopwords), max_block_size)
    top = top_partners(pairs, neighbours)
    sides = top.select(F.least("ref", "partner").alias("left"), F.greatest("ref", "partner").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))
    kept = pairs.join(sides.filter(F.col("n") >= (2 if scope == "mutual" else 1)).drop("n"), ["left", "right"])
    # P11: the smaller of (cluster, home, target) leads
    first = F.col("left_cluster") < F.col("right_cluster")
    return kept.select(
        F.when(first, F.col("left")).otherwise(F.col("right")).alias("home"), F.when(first, F.col("right")).otherwise(F.col("left")).alias("target"),
        F.least("left_cluster", "right_cluster").alias("home_cluster"), F.greatest("left_cluster", "right_cluster").alias("target_cluster"), "weight",
    )


# ---- seeds ---------------------------------------------------------------------------------------


def simple_seeds(records: DataFrame, fields: Fields, min_score: float | None = None, **options) -> DataFrame:
    """G2. A seed for each blocked pair whose score reaches ``min_score``; one link each."""
    pairs = token_blocking(records, fields, **options).withColumnRenamed("home", "home_ref").withColumnRenamed("target", "target_ref")
    scored = score_pairs(pairs, records, fields, "home_ref", "target_ref")
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    key = F.concat_ws(SEPARATOR, *[F.col(c).cast("string") for c in ("home_ref.source", "home_ref.label", "target_ref.source", "target_ref.label")])
    return scored.select("home_cluster", "home_ref", "target_cluster", "target_ref", F.array("target_ref").alias("linked"), F.lit(False).alias("is_short"), "score", key.alias("label_key"))


def greedy_all(edges: DataFrame) -> DataFrame:
    """W5. Greedy pairing without a threshold: a home meets exactly the clusters after it; the best wins, the first of equals."""
    later = edges.filter("target > home")
    return later.groupBy("home").agg(F.max_by(F.struct("target", "score"), F.struct("score", -F.col("target"))).alias("p")).select("home", "p.target", "p.score")


def greedy_from(edges: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """W6. Greedy pairing for each threshold: homes in order; the best target that is no accepted home; accepted from the threshold on.

    A home that has a target after it is accepted, as that one cannot have been accepted yet; so is one with a target that
    is not accepted. A home whose targets are all accepted homes before it is not. So homes are settled in rounds over
    all thresholds at once; when the edges of homes left open are few, one task settles them in order.
    """
    spark = edges.sparkSession
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = checkpoint(edges.withColumn("threshold", F.explode(F.filter(grid, lambda t: t <= F.col("score")))))
    keys = ["threshold", "home"]
    later = F.max(F.col("target") > F.col("home"))
    state = checkpoint(rows.groupBy(*keys).agg(later.alias("accepted")).withColumn("accepted", F.when(F.col("accepted"), True)))

    def of_targets(some: DataFrame) -> DataFrame:
        """Rows with their targets' state; targets that are no homes are free."""
        named = state.select("threshold", F.col("home").alias("target"), F.coalesce(F.col("accepted").cast("int"), F.lit(-1)).alias("taken"))
        return some.join(named, ["threshold", "target"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        accepted: dict[int, bool] = {}
        for home, options in group.sort_values(["home", "target"]).groupby("home", sort=True):
            accepted[home] = any(taken == 0 or taken == -1 and not accepted[target] for target, taken in zip(options["target"], options["taken"], strict=True))
        return pd.DataFrame({"threshold": group["threshold"].iloc[0], "home": list(accepted), "accepted": list(accepted.values())})

    while True:
        open_rows = checkpoint(of_targets(rows.join(state.filter("accepted IS NULL").select(*keys), keys, "left_semi")))
        n = open_rows.count()
        if not n:
            break
        if n <= FEW_EDGES:
            settled = open_rows.groupBy("threshold").applyInPandas(in_order, "threshold double, home long, accepted boolean")
        else:
            free, taken = F.max(F.col("taken") == 0), F.min(F.col("taken") == 1)
            settled = open_rows.groupBy(*keys).agg(F.when(free, True).when(taken, False).alias("accepted"))
        state = checkpoint(state.filter("accepted IS NOT NULL").unionByName(settled))
    free = of_targets(rows).filter((F.col("target") > F.col("home")) | (F.col("taken") != 1))
    best = F.max_by(F.struct("target", "score"), F.struct("score", -F.col("target"))).alias("p")
    found = free.groupBy(*keys).agg(best).select("threshold", "home", "p.target", "p.score")
    return found if thresholds else spark.createDataFrame([], "threshold double, home long, target long, score double")


def greedy_seeds(records: DataFrame, fields: Fields, min_score: float | None = None, links: int = 1) -> DataFrame:
    """G3. A seed for each accepted pair of clusters: the home's representative and the target's first ``links`` members."""
    ranked = checkpoint(rank_members(records, fields))
    edges = affinity(records, ranked, fields, links, min_score, later_only=min_score is None)
    pairs = greedy_all(edges) if min_score is None else greedy_from(edges, [min_score]).drop("threshold")
    members = ranked.filter(F.col("rank") < links).groupBy(F.col("cluster_id").alias("target")).agg(F.sort_array(F.collect_list(F.struct("rank", "ref"))).alias("m"))
    rep = ranked.filter("rank = 0").select(F.col("cluster_id").alias("home"), F.col("ref").alias("home_ref"))
    linked = F.transform("m", lambda x: x["ref"])
    return pairs.join(rep, "home").join(members, "target").select(
        F.col("home").alias("home_cluster"), "home_ref", F.col("target").alias("target_cluster"), F.element_at(linked, 1).alias("target_ref"), linked.alias("linked"),
        (F.size("m") < links).alias("is_short"), "score", F.col("home").cast("string").alias("label_key"),
    )


def seeds(records: DataFrame, fields: Fields, strategy: str = "greedy-cluster-reps", min_score: float | None = None, links: int = 1, **options) -> DataFrame:
    """The seeds of a strategy."""
    if strategy == "greedy-cluster-reps":
        return greedy_seeds(records, fields, min_score, links)
    if strategy == "simple-pairs":
        return simple_seeds(records, fields, min_score, **options)
    raise ValueError(f"unknown pairing strategy: {strategy}")


def summary(found: DataFrame) -> DataFrame:
    """A15. Bridges, links, and bridges with fewer links than asked for."""
    return found.agg(F.count("*").alias("bridge_count"), F.coalesce(F.sum(F.size("linked")), F.lit(0)).cast("long").alias("link_count"), F.count_if("is_short").alias("short_bridge_count"))


def greedy_summaries(records: DataFrame, fields: Fields, thresholds: Sequence[float], links: int = 1) -> DataFrame:
    """G4. Bridges, links and short bridges for each threshold, from one affinity table."""
    ranked = checkpoint(rank_members(records, fields))
    edges = checkpoint(affinity(records, ranked, fields, links, min(thresholds)))
    sizes = ranked.groupBy(F.col("cluster_id").alias("target")).agg(F.least(F.count("*"), F.lit(links)).alias("n"))
    grid = records.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    found = greedy_from(edges, thresholds).join(sizes, "target").groupBy("threshold").agg(
        F.count("*").alias("bridge_count"), F.sum("n").alias("link_count"), F.count_if(F.col("n") < links).alias("short_bridge_count")
    )
    return grid.join(found, "threshold", "left").select("threshold", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bridge_count", "link_count", "short_bridge_count")])
