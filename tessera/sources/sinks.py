"""Sinks: variants, metadata, reports, results and graphs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.bridges import Variant
from ..operators.numbering import number_rows
from .tables import exists


def ids_frame(records: DataFrame) -> DataFrame:
    """K2. Records as they are saved: identity first, no reserved properties."""
    return records.select("alpha", F.col("ref.label").alias("id"), F.col("ref.source").alias("source"), *[c for c in records.columns if c not in ("alpha", "ref", "cluster_id")])


def cluster_frame(clusters: DataFrame) -> DataFrame:
    """K3. In order of cluster, source and label."""
    rows = clusters.select(*[c for c in ("alpha",) if c in clusters.columns], F.col("ref.label").alias("id"), F.col("ref.source").alias("source"), "cluster_id")
    return rows.orderBy(*[c for c in ("alpha",) if c in clusters.columns], "cluster_id", "source", "id")


def mapping_frame(truth: DataFrame) -> DataFrame:
    """K4."""
    lead = [c for c in ("alpha",) if c in truth.columns]
    return truth.select(*lead, F.col("left.label").alias("left_id"), F.col("left.source").alias("left_source"), F.col("right.label").alias("right_id"), F.col("right.source").alias("right_source"), F.col("label").cast("int").alias("label"))


def directory_name(dataset: str, alpha: float, links: int = 1, directed: bool = False) -> str:
    """K6. A variant's folder."""
    return f"amb_{dataset}_a{round(alpha * 100):03d}" + (f"_k{links}" if links > 1 else "") + ("_dir" if directed else "")


def write_variants(variant: Variant, out: str, dataset: str, links: int = 1, single_file: bool = True) -> list[str]:
    """K1, K5. For each alpha an undirected and a directed folder with ids, mapping and cluster_mapping as CSV; logs that are not empty.

    ``single_file`` gathers each table into one file, as its readers expect; large tables keep their parts.
    """
    alphas = sorted(r["alpha"] for r in variant.records.select("alpha").distinct().collect())

    def save(df: DataFrame, path: str) -> None:
        (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)

    made = []
    for alpha in alphas:
        one = variant.at(alpha)
        for directed, truth in ((False, one.undirected), (True, one.directed)):
            folder = f"{out}/{directory_name(dataset, alpha, links, directed)}"
            save(ids_frame(one.records).drop("alpha"), f"{folder}/ids.csv")
            save(mapping_frame(truth).drop("alpha"), f"{folder}/mapping.csv")
            save(cluster_frame(one.clusters).drop("alpha"), f"{folder}/cluster_mapping.csv")
            made.append(folder)
    for name, log in (("bridge_log", variant.bridge_log), ("link_log", variant.link_log)):
        if log.limit(1).count():
            save(log, f"{out}/{dataset}_{name}.csv")
    return made


def upsert_rows(held: DataFrame | None, new: DataFrame, key: str = "dataset") -> DataFrame:
    """K7. The table with rows of the same keys replaced and others added; its columns first, new ones after."""
    if held is None:
        return new
    kept = held.join(new.select(key).distinct(), key, "left_anti").select(held.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "dataset") -> None:
    """K7. Into a saved table; the new state is written whole beside the old one before it takes its place."""
    held = spark.read.parquet(path) if exists(spark, path) else None
    fresh = f"{path}.{uuid.uuid4().hex}"
    upsert_rows(held, new, key).write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if held is not None:
        files.delete(hadoop(path), True)
    if not files.rename(hadoop(fresh), hadoop(path)):
        raise OSError(f"{fresh} could not take the place of {path}")


def identity_row(spark: SparkSession, dataset: str, settings: Mapping[str, object], pairing: Mapping[str, object], paths: Mapping[str, str]) -> DataFrame:
    """K8. One row: the dataset, its settings, the pairing's settings and paths."""
    values = {"dataset": dataset, **settings, **pairing, **paths}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def write_components(components: DataFrame, path: str) -> None:
    """K9."""
    components.drop("clusters").orderBy("bridge_component").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_report(tables: Mapping[str, DataFrame], out: str) -> bool:
    """K10. Report tables by name, those that have rows; nothing if no dataset was analysed."""
    held = {name: df for name, df in tables.items() if df.limit(1).count()}
    for name, df in held.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{out}/{name}.csv", header=True)
    return bool(held)


def write_chart(tables: Mapping[str, DataFrame], path: str) -> None:
    """K14. The tables that a chart is drawn from, side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_results(results: DataFrame, path: str) -> None:
    """K11."""
    flat = results.select(*[F.col(f"{side}.{part}").alias(f"{side}_{name}") for side in ("left", "right") for name, part in (("id", "label"), ("source", "source"))], *[c for c in results.columns if c not in ("left", "right", "seq")])
    flat.write.mode("overwrite").csv(path, header=True)


def write_asymmetry(rows: DataFrame, out: str) -> None:
    """K12. One folder for each dataset and model, and all of them together."""
    flat = rows.select("dataset", "model", *[F.col(f"{side}.{part}").alias(f"{side}_{name}") for side in ("left", "right") for name, part in (("id", "label"), ("source", "source"))], "xy_label", "yx_label", "xy_weight", "yx_weight", "hamming")
    flat.write.mode("overwrite").partitionBy("dataset", "model").csv(f"{out}/each", header=True)
    flat.write.mode("overwrite").csv(f"{out}/all.csv", header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K13."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K13. A graph as lines of GML, one row a line, in order: nodes with a number, a source and a ref, edges with a label and a weight."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    whole = isinstance(nodes.schema["ref"].dataType["label"].dataType, IntegralType)
    name = F.col("ref.label").cast("string") if whole else quoted(F.col("ref.label"))
    named = number_rows(nodes.select("ref"), ["ref"], "id")
    n = named.select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("  node [ id %d source %s ref %s ]", "id", quoted(F.col("ref.source")), name).alias("line"))
    end = lambda c, key: named.select(F.col("ref").alias(c), F.col("id").alias(key))
    joined = edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    e = joined.select(F.lit(2).alias("k"), "a", "b", F.format_string("  edge [ source %d target %d label %d weight %s ]", "a", "b", F.col("label").cast("int"), F.col("weight").cast("double").cast("string")).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, 0, 0, "graph ["), (0, 0, 1, "  directed 1"), (3, 0, 0, "]")], "k int, a long, b long, line string")
    return frame.unionByName(n).unionByName(e).orderBy("k", "a", "b").select("line")


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K13. A graph as one GML file in a folder; GML is one document, so its lines are gathered in order."""
    gml_lines(nodes, edges).coalesce(1).write.mode("overwrite").text(path)
