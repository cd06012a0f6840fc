"""Records of entities, their clusters and their labels.

A record has ``ref``, a struct of source and label (so refs sort by source, then label), ``cluster_id``
and its fields as typed columns. Whether a null field is a value of its own or an absent one is
the dataset's choice (``Fields.null_is_absent``).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import uuid5
from .components import connected_components
from .numbering import number_rows

BRIDGE_SOURCE = "ambiguity-generator"
RESERVED = ("source", "target", "target_cluster_id")


@dataclass(frozen=True)
class Fields:
    """Compared fields: all of them, those that ambiguity targets, and those copied from the home record."""

    names: tuple[str, ...]
    targets: frozenset[str] = frozenset()
    secondary: frozenset[str] = frozenset()
    text: frozenset[str] = field(default=frozenset())
    null_is_absent: bool = False

    @classmethod
    def of(cls, df: DataFrame, names: Sequence[str] | None = None, targets: Sequence[str] = (), secondary: Sequence[str] = (), null_is_absent: bool = False) -> Fields:
        """P2: the fields as given, or all columns but identity in name order."""
        if names is None:
            names = sorted(c for c in df.columns if c not in ("ref", "cluster_id", *RESERVED))
        if reserved := set(RESERVED) & {*targets, *secondary}:
            raise ValueError(f"reserved properties cannot be targets or secondary features: {sorted(reserved)}")
        text = frozenset(f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, T.StringType))
        return cls(tuple(sorted(names)), frozenset(targets), frozenset(secondary), text, null_is_absent)


def ref(source: Column | str, label: Column | str) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(source.alias("source"), (F.col(label) if isinstance(label, str) else label).alias("label"))


def to_records(df: DataFrame, label: str, source: Column | str, fields: Sequence[str], cluster: Sequence[Column | str] | None = None) -> DataFrame:
    """S2. A source as records; ``cluster`` names what members of a cluster share."""
    columns = [ref(source, label).alias("ref")]
    if cluster is not None:
        columns.append(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(cluster)]).alias("cluster_key"))
    rows = df.select(*columns, *fields)
    return number_clusters(rows, "cluster_key").drop("cluster_key") if cluster is not None else rows


def number_clusters(members: DataFrame, key: str) -> DataFrame:
    """W1. ``cluster_id`` 1..N in order of clusters' sorted members; as clusters are disjoint, of their least one.

    The numbering runs over one row a cluster; members get theirs by a join.
    """
    least = members.groupBy(key).agg(F.min("ref").alias("__least"))
    numbered = number_rows(least, ["__least"], "cluster_id").drop("__least")
    return members.join(numbered.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def clusters_of_matches(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """Clusters where only matching pairs are given: connected components, with every other ref alone."""
    found = connected_components(matches, "left", "right")
    rows = refs.select("ref").join(found, F.col("ref") == F.col("node"), "left").select("ref", F.coalesce("component", "ref").alias("key"))
    return number_clusters(rows, "key").drop("key")


def restrict_clusters(clusters: DataFrame, refs: DataFrame) -> DataFrame:
    """S7. Clusters kept to given refs; refs in none become clusters of their own, numbered on in order of appearance.

    refs: ``ref`` and ``position``.
    """
    held = clusters.join(refs.select("ref"), "ref", "left_semi").select("ref", F.col("cluster_id").cast("long").alias("cluster_id"))
    top = clusters.agg(F.coalesce(F.max("cluster_id"), F.lit(0)).cast("long").alias("top"))
    alone = number_rows(refs.join(clusters.select("ref"), "ref", "left_anti"), ["position"], "turn")
    return held.unionByName(alone.join(F.broadcast(top)).select("ref", (F.col("top") + F.col("turn")).alias("cluster_id")))


def downscale_clusters(clusters: DataFrame, comparisons: DataFrame, matches: DataFrame) -> DataFrame:
    """U7. Members touched by a comparison that is a true match, in clusters of more than one, numbered anew from 1."""
    true = comparisons.select("left", "right").join(matches.select("left", "right"), ["left", "right"], "left_semi")
    touched = true.select(F.explode(F.array("left", "right")).alias("ref")).distinct()
    held = clusters.join(touched, "ref", "left_semi")
    several = held.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("ref").alias("least")).filter("n > 1")
    numbered = number_rows(several.select("cluster_id", "least"), ["least"], "new_id").drop("least")
    return held.join(numbered, "cluster_id").select("ref", F.col("new_id").alias("cluster_id"))


# ---- labels of bridges ---------------------------------------------------------------------------


def label_kind(df: DataFrame, label: str = "ref.label") -> str:
    """F21. ``integer`` or ``string``; one kind a dataset."""
    kind = df.select(label).schema[0].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, T.StringType):
        return "string"
    raise TypeError(f"labels must be integers or strings, not {kind.simpleString()}")


def integer_labels(seeds: DataFrame, records: DataFrame, order: Sequence[str]) -> DataFrame:
    """F20. ``bridge_label``: the largest label plus 1, 2, ... in seed order."""
    top = records.agg(F.coalesce(F.max("ref.label"), F.lit(0)).cast("long").alias("__top"))
    return number_rows(seeds, order, "__turn").join(F.broadcast(top)).withColumn("bridge_label", F.col("__top") + F.col("__turn")).drop("__top", "__turn")


def text_labels(seeds: DataFrame, dataset: str, key: str = "label_key", namespace: uuid.UUID = uuid.NAMESPACE_URL) -> DataFrame:
    """F19. ``bridge_label``: a name-based identifier of the dataset and the seed's key."""
    return seeds.withColumn("bridge_label", uuid5(namespace.bytes, F.concat(F.lit(dataset + "\x1f"), F.col(key).cast("string"))))


def drop_reserved(df: DataFrame) -> DataFrame:
    """P1."""
    return df.drop(*RESERVED)


def cluster_count(records: DataFrame) -> DataFrame:
    """A28. ``n``, the number of clusters; by partial counts, so that no task holds all members."""
    return records.groupBy("cluster_id").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n"))


def clusters_by_size(records: DataFrame) -> DataFrame:
    """W11. (place, cluster_id, n): the largest cluster first, of equal ones that with the first member."""
    sized = records.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("ref").alias("least"))
    return number_rows(sized, [F.desc("n"), F.col("least")], "place").select("place", "cluster_id", "n")


# ---- corpus terms --------------------------------------------------------------------------------


def term_scores(records: DataFrame, fields: Fields, stopwords: Sequence[str]) -> DataFrame:
    """A17. (term, score): occurrences of a term over the number of records that have it."""
    from ..functions.text import all_tokens

    words = F.flatten(F.array(*[all_tokens(F.col(f), stopwords) for f in fields.names if f in fields.text]))
    by_record = records.select("ref", F.explode(words).alias("term")).groupBy("ref", "term").agg(F.count("*").alias("n"))
    return by_record.groupBy("term").agg((F.sum("n") / F.count("*")).alias("score"))


def bridge_terms(records: DataFrame, fields: Fields, stopwords: Sequence[str], n: int = 10) -> list[str]:
    """W12. The best terms; ties in order of first appearance stand in term order here, as rows have none."""
    return [r.term for r in term_scores(records, fields, stopwords).orderBy(F.desc("score"), "term").limit(n).collect()]


def secondary_counts(seeds: DataFrame, records: DataFrame, fields: Fields) -> DataFrame:
    """A25. For each secondary field: how many home values were copied, missing, and equal to the target's."""
    home = records.select(F.col("ref").alias("home_ref"), *[F.col(f).alias(f"home_{f}") for f in fields.secondary])
    target = records.select(F.col("ref").alias("target_ref"), *[F.col(f).alias(f"target_{f}") for f in fields.secondary])
    rows = seeds.join(home, "home_ref").join(target, "target_ref")
    out = None
    for f in sorted(fields.secondary):
        h, t = F.col(f"home_{f}"), F.col(f"target_{f}")
        empty = h.isNull() | (h.cast("string").isin("", "0", "0.0", "false"))
        one = rows.agg(F.count_if(~empty).alias("copied"), F.count_if(empty).alias("missing"), F.count_if(~empty & h.eqNullSafe(t)).alias("equal")).select(F.lit(f).alias("field"), "copied", "missing", "equal")
        out = one if out is None else out.unionByName(one)
    return out


def pivoted_names(names: Mapping[str, str], df: DataFrame) -> DataFrame:
    """S3. A mapping file's columns by name or position, under their own names."""
    columns = []
    for new, old in names.items():
        columns.append((F.col(df.columns[old]) if isinstance(old, int) else F.col(old)).alias(new))
    return df.select(*columns)
