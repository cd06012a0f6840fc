"""Numbers of rows in a global order, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: ranges of hashes that are counted
BUCKET_BITS = 14


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order given.

    Rows are dealt out by ranges of the order and numbered within each range; ranges before it add their counts. The
    ranges are written once, as they are sampled anew by each run. Only the counts, one for each range, are broadcast.
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__local", local).join(F.broadcast(base), "__range").withColumn(name, (F.col("__base") + F.col("__local")).cast("long")).drop("__range", "__local", "__base")


def first_by_hash(df: DataFrame, n: int, keys: Sequence[str], seed: int) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest seeded hashes of ``keys`` (all, if fewer): a fixed sample of any size.

    The hash range up to which all rows belong is found from counts by ranges; only the rows of the one range
    that is cut are sorted. Rows are computed twice, so ``df`` should be a written table.
    """
    hashed = df.withColumn("__h", F.xxhash64(*keys, F.lit(seed)))
    bucket = F.shiftright("__h", 64 - BUCKET_BITS)
    below, cut = 0, None
    for b, held in sorted((r["b"], r["n"]) for r in hashed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()):
        if below + held > n:
            cut = b
            break
        below += held
    if cut is None:
        return df
    last = hashed.filter(bucket == cut).orderBy("__h", *keys).limit(n - below)
    return hashed.filter(bucket < cut).unionByName(last).drop("__h")
