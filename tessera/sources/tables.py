"""Sources: benchmark datasets, mappings, clusters, comparison spaces, graphs, scalars and layouts, from any path Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import without_pairs
from ..operators.numbering import number_rows
from ..operators.records import pivoted_names, ref
from ..runtime import checkpoint
from .events import read_events


def read(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A table by the ending of its path: CSV, JSON, ORC, text, else Parquet. Without a schema CSV columns are text."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=header, escape='"', multiLine=True)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    return spark.read.text(path) if kind == "txt" else reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds something, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def dataset(sources: Mapping[str, DataFrame], label: str | Mapping[str, str], fields: Sequence[str], source_column: str | None = None) -> DataFrame:
    """S2. Records of several sources; the source is a column, or the source's name."""
    out = None
    for name, df in sources.items():
        own = label if isinstance(label, str) else label[name]
        source = F.col(source_column) if source_column else F.lit(name)
        rows = df.select(ref(source, own).alias("ref"), *fields)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def mapping(df: DataFrame, columns: Mapping[str, str | int], left_source: str, right_source: str) -> DataFrame:
    """S3. (left, right, label) of a pairwise mapping: columns by name or position; sources and label where the file has none."""
    rows = pivoted_names(columns, df)
    has = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other
    return rows.select(
        ref(has("left_source", F.lit(left_source)), "left_id").alias("left"), ref(has("right_source", F.lit(right_source)), "right_id").alias("right"),
        has("label", F.lit(1)).cast("int").alias("label"),
    )


def comparison_space(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """S4. The saved comparisons, or new ones, saved first."""
    if not exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def without_saved(pairs: DataFrame, spark: SparkSession, files: Sequence[str] | None) -> DataFrame:
    """S5. Pairs that no other comparison space has; without any file all of them."""
    for path in files or ():
        pairs = without_pairs(pairs, spark.read.parquet(path))
    return pairs


def row_count(spark: SparkSession, path: str, header: bool = True) -> int | None:
    """S6. Rows of a file; None if there is none."""
    return read(spark, path, header=header).count() if exists(spark, path) else None


def clusters(df: DataFrame, id_column: str = "id", source_column: str = "source", cluster_column: str = "cluster_id") -> DataFrame:
    """(ref, cluster_id) of a cluster table."""
    return df.select(ref(F.col(source_column), id_column).alias("ref"), F.col(cluster_column).cast("long").alias("cluster_id"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8. (nodes, edges) of a saved graph."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def result_pairs(df: DataFrame) -> DataFrame:
    """S11. The compared pairs of saved results."""
    return df.select(ref(F.col("left_source"), "left_id").alias("left"), ref(F.col("right_source"), "right_id").alias("right"))


def scalars(spark: SparkSession, path: str, model: str | None = None, feature: str | None = None) -> DataFrame:
    """S9. (step, tag, value, ordinal) of a folder and those below: of event files where there are any, with the model as
    their tag, else of tables; by model, and by a feature that is in the name of the folder they lie in."""
    try:
        events = read_events(spark, path)
        if events.limit(1).count():
            if model is not None:
                events = events.filter(F.col("tag") == model)
            if feature is not None:
                events = events.filter(F.contains(F.element_at(F.split("path", "/"), -2), F.lit(feature)))
            return number_rows(events, ["path", "place"], "ordinal").select("step", "tag", "value", "ordinal")
        rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "step long, tag string, value double, ordinal long")
    if model is not None and "model" in rows.columns:
        rows = rows.filter(F.col("model") == model)
    if feature is not None:
        rows = rows.filter(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) == feature)
    return rows.select("step", "tag", "value", "ordinal")


#: an element of a GML file that holds no further one; brackets within quotes are text
_ELEMENT = r'\bNAME\s*\[((?:[^\[\]"]|"[^"]*")*)\]'


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8, K13. (nodes, edges) of a GML file, with refs as ``sinks.write_gml`` names them; edges have a label and a weight."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("gml"))
    kind = lambda name: text.select(F.explode(F.regexp_extract_all("gml", F.lit(_ELEMENT.replace("NAME", name)), F.lit(1))).alias("e"))
    number = lambda key: F.regexp_extract("e", rf"\b{key}\s+(-?[0-9.eE+-]+)", 1)
    plain = lambda c: F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    quoted = lambda key: plain(F.regexp_extract("e", rf'\b{key}\s+"([^"]*)"', 1))
    whole = F.regexp_like(F.col("e"), F.lit(r"\bref\s+-?[0-9]"))
    named = kind("node").select(number("id").cast("long").alias("id"), ref(quoted("source"), F.when(whole, number("ref")).otherwise(quoted("ref"))).alias("ref"), whole.alias("whole"))
    nodes = checkpoint(named)
    if nodes.filter("NOT whole").limit(1).count() == 0:
        nodes = nodes.withColumn("ref", ref(F.col("ref.source"), F.col("ref.label").cast("long")))
    ends = kind("edge").select(number("source").cast("long").alias("s"), number("target").cast("long").alias("t"), number("label").cast("int").alias("label"), number("weight").cast("double").alias("weight"))
    end = lambda key, name: nodes.select(F.col("id").alias(key), F.col("ref").alias(name))
    return nodes.select("ref"), ends.join(end("s", "src"), "s").join(end("t", "dst"), "t").select("src", "dst", "label", "weight")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """S10. (ref, x, y) of a saved layout."""
    return spark.read.json(path).select("ref", "x", "y")
