"""The ``evaluate`` pipelines: matching, clustering, confusion matrices and asymmetry. Datasets, models and orders are rows of
one table where the work allows it; only what a configuration names is looped over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BenchmarkConfig, ConfigError, EvaluationConfig, MatcherConfig
from ..functions.messages import stale_message
from ..operators import charts as C
from ..operators import graphs as G
from ..operators import matching as M
from ..operators.clustering import cluster
from ..operators.metrics import best_cluster_matches, cluster_quality
from ..operators.numbering import number_rows
from ..operators.profiles import sampled_negatives
from ..operators.records import restrict_clusters
from ..runtime import checkpoint
from ..sources import sinks, tables
from .datasets import Dataset, load_dataset

def _spark_model(config: MatcherConfig, fields: Sequence[str], dataset: str) -> M.Matcher:
    from pyspark.ml import PipelineModel

    return M.model_matcher(PipelineModel.load(config.path_for(dataset)), fields)


#: Matchers by configured type; others can be added.
MATCHERS = {"coverage": lambda c, fields, dataset: M.coverage_matcher(fields, c.match, c.one_way), "spark-ml": _spark_model}


def matcher_of(config: MatcherConfig, fields: Sequence[str], dataset: str) -> M.Matcher:
    if config.type not in MATCHERS:
        raise ConfigError(f"no matcher of type {config.type!r} is registered")
    return MATCHERS[config.type](config, fields, dataset)


def space_of(spark: SparkSession, config: BenchmarkConfig, data: Dataset, out: str, seed: int) -> DataFrame:
    """S4, E9. The saved comparisons, or new ones: (seq, left, right)."""
    space = config.comparison_space

    def build() -> DataFrame:
        truth = data.matches
        if space.bridge_source:
            M.check_source(data.records, space.bridge_source)
            bridged = M.is_bridge(F.col("left"), space.bridge_source) | M.is_bridge(F.col("right"), space.bridge_source)
            truth = truth.withColumn("label", F.when((F.col("label") > 0) & bridged, F.greatest("label", F.lit(2))).otherwise(F.col("label")))
        positives = checkpoint(truth.filter("label > 0"))
        negatives = sampled_negatives(data.records.select("ref", "cluster_id"), positives, round(space.neg_pos_ratio * positives.count()), seed)
        made = M.comparison_space(positives, negatives, space.neg_pos_ratio, space.match_bridge_ratio if space.bridge_source else None, space.sample_count, seed)
        return tables.without_saved(made, spark, [f"{out}/{f}" for f in space.excluded_files or ()])

    rows = tables.comparison_space(spark, f"{out}/{space.file_name}", build)
    return rows.withColumn("seq", F.struct("left", "right"))


def _units(spark: SparkSession, config: EvaluationConfig, out: str, root: str):
    for benchmark in config.benchmark_data:
        data = load_dataset(spark, benchmark.dataset, root)
        comparisons = checkpoint(space_of(spark, benchmark, data, out, config.seed))
        for model in config.matching:
            yield benchmark, data, comparisons, model


def matching(spark: SparkSession, config: EvaluationConfig, out: str, orders: Sequence[str] = (M.NORMAL,), degrade: bool = False, skip_existing: bool = False, root: str = ".", graph_plots: str | None = None) -> DataFrame:
    """``evaluate matching``: graphs, results and a row of metrics for each dataset, model and order; the tables of their charts go to ``graph_plots``."""
    stats = None
    for benchmark, data, comparisons, model in _units(spark, config, out, root):
        for order in M.check_orders(orders):
            graph_path = f"{out}/graphs/{benchmark.name}/{model.name}/{order}"
            truth = data.matches.filter("label > 0")
            if skip_existing and tables.exists(spark, f"{graph_path}/edges"):
                nodes, graph = tables.graph(spark, graph_path)
                refs = comparisons.select(F.explode(F.array("left", "right")).alias("ref")).distinct()
                stale = G.staleness(nodes, graph, refs, comparisons).first()
                if any(stale):
                    raise ValueError(stale_message(graph_path, *stale))
                results = spark.read.parquet(f"{out}/results/{benchmark.name}/{model.name}/{order}")
            else:
                results = checkpoint(M.run_matcher(matcher_of(model, data.fields, benchmark.name), comparisons, data.records, data.fields, order))
                if degrade:
                    graph = G.match_graph(results, degrade=True)
                else:
                    graph = G.match_graph(results)
                refs = comparisons.select(F.explode(F.array("left", "right")).alias("ref")).distinct()
                sinks.write_graph(refs, graph, graph_path)
                results.write.mode("overwrite").parquet(f"{out}/results/{benchmark.name}/{model.name}/{order}")
                sinks.write_results(M.saved_results(M.recorded_labels(results, comparisons, truth)), f"{out}/results/{benchmark.name}_{model.name}_{order}.csv")
            if graph_plots:
                places = checkpoint(C.graph_places(comparisons.select(F.explode(F.array("left", "right")).alias("ref")).distinct(), graph))
                classes = G.classify_edges(graph, truth.select(F.col("left").alias("src"), F.col("right").alias("dst")))
                sinks.write_chart({"places": places, "lines": C.edge_lines(classes, places)}, f"{graph_plots}/{benchmark.name}/{model.name}/{order}")
            _, metrics = M.evaluate_matching(results, comparisons, truth, degrade)
            row = metrics.select(F.lit(benchmark.name).alias("dataset"), F.lit(model.name).alias("model"), F.lit(order).alias("input_order"), *metrics.columns)
            stats = row if stats is None else stats.unionByName(row, allowMissingColumns=True)
    if stats is None:
        raise ConfigError("no matcher is configured")
    stats = checkpoint(stats)
    stats.coalesce(1).write.mode("overwrite").csv(f"{out}/matching_stats.csv", header=True)
    return stats


def clustering(spark: SparkSession, config: EvaluationConfig, out: str, orders: Sequence[str] = (M.NORMAL,), root: str = ".", cluster_plots: str | None = None) -> DataFrame:
    """``evaluate clustering``: eight metrics of each algorithm over each saved graph. All datasets must have true clusters.

    The tables of charts go to ``cluster_plots``: members at their places, with the true cluster that theirs matches.
    """
    loaded = {b.name: load_dataset(spark, b.dataset, root) for b in config.benchmark_data}
    if missing := [n for n, d in loaded.items() if not d.has_clusters]:
        raise ConfigError(f"datasets without true clusters: {missing}")
    stats = None
    for name, data in loaded.items():
        for model in config.matching:
            for order in M.check_orders(orders):
                nodes, edges = tables.graph(spark, f"{out}/graphs/{name}/{model.name}/{order}")
                placed = number_rows(nodes, ["ref"], "position")
                true = checkpoint(restrict_clusters(data.records.select("ref", "cluster_id"), placed))
                for algorithm in config.algorithms:
                    found = cluster(nodes, edges, algorithm)
                    if cluster_plots:
                        held = checkpoint(found)
                        members = G.prediction_nodes(true, held, checkpoint(best_cluster_matches(true, held)))
                        sinks.write_chart({"places": C.cluster_places(held), "members": members}, f"{cluster_plots}/{name}/{model.name}/{order}/{algorithm}")
                    one = cluster_quality(true, found)
                    row = one.select(F.lit(name).alias("dataset"), F.lit(algorithm).alias("algorithm"), F.lit(model.name).alias("matcher"), F.lit(order).alias("input_order"), *one.columns)
                    stats = row if stats is None else stats.unionByName(row)
    if stats is None:
        raise ConfigError("no clustering algorithm or matcher is configured")
    stats = checkpoint(stats)
    stats.coalesce(1).write.mode("overwrite").csv(f"{out}/clustering_stats.csv", header=True)
    return stats


def confusion_matrix(spark: SparkSession, config: EvaluationConfig, out: str, orders: Sequence[str] = (M.NORMAL,), root: str = ".") -> DataFrame:
    """``evaluate confusion-matrix``: counts of true against predicted labels from saved results."""
    out_rows = None
    for benchmark, data, comparisons, model in _units(spark, config, out, root):
        for order in M.check_orders(orders):
            results = spark.read.parquet(f"{out}/results/{benchmark.name}/{model.name}/{order}")
            graph = G.match_graph(results)
            pairs = M.labelled_pairs(graph, comparisons, data.matches.filter("label > 0"))
            from ..operators.metrics import confusion

            one = confusion(pairs, "y_true", "y_pred")
            row = one.select(F.lit(benchmark.name).alias("dataset"), F.lit(model.name).alias("model"), F.lit(order).alias("input_order"), *one.columns)
            out_rows = row if out_rows is None else out_rows.unionByName(row)
    if out_rows is None:
        raise ConfigError("no matcher is configured")
    out_rows = checkpoint(out_rows)
    out_rows.coalesce(1).write.mode("overwrite").csv(f"{out}/confusion_matrix.csv", header=True)
    return out_rows


def asymmetry(spark: SparkSession, config: EvaluationConfig, out: str, root: str = ".") -> DataFrame:
    """``evaluate asymmetry``: labels of both input orders side by side."""
    rows = None
    for benchmark, data, comparisons, model in _units(spark, config, out, root):
        results = M.run_matcher(matcher_of(model, data.fields, benchmark.name), comparisons, data.records, data.fields, M.BOTH)
        one = M.asymmetry(results).withColumns({"dataset": F.lit(benchmark.name), "model": F.lit(model.name)})
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ConfigError("no matcher is configured")
    rows = checkpoint(rows)
    sinks.write_asymmetry(rows, f"{out}/asymmetry")
    return rows


def scalar_table(spark: SparkSession, logs: str, models: Mapping[str, str | None], window: int = 5) -> DataFrame:
    """``plot-tensorboard``: smoothed series of each model, ready to be drawn; ``models`` maps a model to its feature folder."""
    from ..operators.series import last_values, smooth, wide

    out = None
    for model, feature in models.items():
        rows = tables.scalars(spark, logs, model, feature)
        tags = sorted(r.tag for r in rows.select("tag").distinct().collect())
        if not tags:
            continue
        table = smooth(wide(last_values(rows).withColumn("ordinal", F.lit(0)), tags), tags, window)
        one = table.select(F.lit(model).alias("model"), "step", F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.col(f"`{t}`") for t in tags]))).alias("tag", "value"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "model string, step long, tag string, value double")
