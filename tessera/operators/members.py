"""Pairs of the members of each group, without one task holding a large group's square."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: members on a side of a block of pairs
BLOCK_ROWS = 2048
#: members that are alike meet others in pieces of so many, as all pairs of two pieces wait in a task's buffer
PIECE_ROWS = 32


def member_pairs(rows: DataFrame, key: str, by: str, left: Mapping[str, str | Column], right: Mapping[str, str | Column], parts: int | None = None) -> DataFrame:
    """``key`` with ``left`` of one and ``right`` of another member, for all ordered pairs of a group, a member with itself as well.

    left and right: names and columns of ``rows``. Groups are cut into blocks by a hash of ``by`` as their counted sizes ask for,
    and the blocks meet as a grid: a group of one block is joined as it is, and a row of a larger one is copied once a block. parts: partitions that blocks are dealt out to, where
    the rows alone are so few that Spark would broadcast them and leave all pairs to one task.
    """
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__n"))
    held = rows.join(blocks, key).withColumn("__own", F.pmod(F.xxhash64(by), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    named = lambda columns: [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    a = held.select(key, *named(left), F.col("__own").alias("__i"), every.alias("__j"))
    b = held.select(key, *named(right), F.col("__own").alias("__j"), every.alias("__i"))
    if parts:
        a, b = (x.repartition(parts, key, "__i", "__j") for x in (a, b))
        b = b.hint("merge")
    return a.join(b, [key, "__i", "__j"]).drop("__i", "__j")


def pairs_of_likes(rows: DataFrame, key: str, by: str, alike: Sequence[str], carried: Sequence[str], settled: Mapping[str, Column], parts: int) -> DataFrame:
    """``key``, left and right (``by`` of both, left less), ``settled``, and ``carried`` of both ends as a_ and b_, for all pairs of a group.

    Members of a block with the same ``alike`` columns are joined as one row, and ``settled``, columns over a_ and b_ of
    these, is computed once for two such rows. Their members are paired after the join, so no pair is made twice or dropped
    again but within a piece. ``a`` may be either end.
    """
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__n"))
    held = rows.join(blocks, key).withColumn("__own", F.pmod(F.xxhash64(by), F.col("__n")).cast("int"))
    member = F.struct(F.col(by).alias("__by"), *carried)
    likes = held.groupBy(key, "__n", "__own", *alike).agg(F.sort_array(F.collect_list(member)).alias("__all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / PIECE_ROWS).cast("int")), lambda k: F.slice("__all", k * PIECE_ROWS + 1, PIECE_ROWS))
    pieces = likes.select(key, "__n", "__own", *alike, F.explode(cut).alias("__m")).withColumn("__first", F.col("__m")[0]["__by"])
    side = lambda e: [F.col(c).alias(f"{e}_{c}") for c in alike] + [F.col("__m").alias(f"__{e}"), F.col("__first").alias(f"__first_{e}")]
    a = pieces.select(key, *side("a"), F.col("__own").alias("__i"), F.explode(F.sequence(F.col("__own"), F.col("__n") - 1)).alias("__j"))
    b = pieces.select(key, *side("b"), F.col("__own").alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__i"))
    a, b = (x.repartition(parts, key, "__i", "__j") for x in (a, b))
    met = a.join(b.hint("merge"), [key, "__i", "__j"]).filter("__i < __j OR __first_a <= __first_b")
    within = (F.col("__i") == F.col("__j")) & (F.col("__first_a") == F.col("__first_b"))
    made = met.select(key, within.alias("__within"), "__a", "__b", *[c.alias(n) for n, c in settled.items()])
    made = made.select("*", F.explode("__a").alias("__z")).select(key, "__within", *settled, "__b", F.col("__z")["__by"].alias("__x"), *[F.col("__z")[c].alias(f"a_{c}") for c in carried])
    made = made.select(key, "__within", *settled, "__x", *[f"a_{c}" for c in carried], F.explode("__b").alias("__z"))
    x, y = F.col("__x"), F.col("__z")["__by"]
    ends = [f"a_{c}" for c in carried] + [F.col("__z")[c].alias(f"b_{c}") for c in carried]
    return made.filter((x < y) | (~F.col("__within") & (x > y))).select(key, F.least(x, y).alias("left"), F.greatest(x, y).alias("right"), *settled, *ends)
