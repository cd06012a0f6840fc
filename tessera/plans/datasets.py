"""Configured datasets as records, clusters and truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..operators.records import clusters_of_matches, number_clusters, ref
from ..sources.tables import mapping, read


@dataclass(frozen=True)
class Dataset:
    name: str
    records: DataFrame
    matches: DataFrame
    fields: tuple[str, ...]
    has_clusters: bool


def _typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identity columns as integers where all their values are; a dataset has one kind of labels."""
    whole = [F.bool_and(F.col(c).rlike(r"^\s*-?\d{1,18}\s*$") | F.col(c).isNull()).alias(str(k)) for k, c in enumerate(columns)]
    flags = df.agg(*whole).first()
    return df.withColumns({c: F.trim(c).cast("long") for k, c in enumerate(columns) if flags[k]})


def load_dataset(spark: SparkSession, config: DatasetConfig, root: str = ".") -> Dataset:
    """S2, S3. Records of all sources with clusters: those mapped, or what matches connect."""
    at = lambda name: f"{root.rstrip('/')}/{config.directory}/{name}" if not config.directory.startswith("/") and "://" not in config.directory else f"{config.directory}/{name}"
    records, fields = None, []
    for source in config.sources:
        df = read(spark, at(source.file_name), header=source.has_header)
        key = df.columns[source.id_col] if isinstance(source.id_col, int) else source.id_col
        df = _typed(df, [key])
        keys = source.keys or [c for c in df.columns if c not in (key, source.source_col)]
        fields += [k for k in keys if k not in fields]
        name = F.col(source.source_col) if source.source_col else F.lit(source.name or (config.name if len(config.sources) == 1 else source.file_name.rpartition("/")[2].partition(".")[0]))
        rows = df.select(ref(name, key).alias("ref"), *keys)
        records = rows if records is None else records.unionByName(rows, allowMissingColumns=True)
    p = config.pairwise_mapping
    pairs = read(spark, at(p.file_name), header=p.has_header)
    columns = {"left_id": p.left_id_col, "right_id": p.right_id_col}
    columns |= {k: v for k, v in (("left_source", p.left_source_col), ("right_source", p.right_source_col)) if v is not None}
    place = lambda c: pairs.columns[c] if isinstance(c, int) else c
    typed = _typed(pairs, [place(p.left_id_col), place(p.right_id_col)])
    label = {"label": "label"} if "label" in pairs.columns else {}
    matches = mapping(typed, columns | label, config.name, config.name)
    if config.cluster_mapping:
        c = config.cluster_mapping
        df = _typed(read(spark, at(c.file_name), header=c.has_header), [c.id_col])
        name = F.col(c.source_col) if c.source_col and c.source_col in df.columns else F.lit(config.name)
        clusters = number_clusters(df.select(ref(name, c.id_col).alias("ref"), F.col(c.label_col).alias("key")), "key").drop("key")
        clusters = records.select("ref").join(clusters, "ref")
    else:
        clusters = clusters_of_matches(records, matches.filter("label > 0"))
    return Dataset(config.name, records.join(clusters, "ref").select("ref", "cluster_id", *fields), matches, tuple(fields), config.cluster_mapping is not None)
