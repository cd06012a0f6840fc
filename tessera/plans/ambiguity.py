"""The ``ambiguity`` pipelines: generate harder variants of a dataset, and analyse thresholds and blend weights."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AmbiguityConfig, ConfigError, InputConfig
from ..functions.sequence import record_similarity
from ..operators import bridges as B
from ..operators import pairing as P
from ..operators import profiles as R
from ..operators import selection as L
from ..operators.charts import sweep_lines
from ..operators.learning import Mixture, grouped_cv_auc, mixture
from ..operators.metrics import class_metrics
from ..operators.records import Fields, bridge_terms, integer_labels, label_kind, text_labels
from ..runtime import checkpoint
from ..sources import sinks
from .datasets import Dataset, load_dataset


@dataclass
class Generator:
    """A dataset with all settings that variants of it depend on."""

    data: Dataset
    entry: InputConfig
    config: AmbiguityConfig
    min_score: float | None = None

    def __post_init__(self) -> None:
        self.records = checkpoint(self.data.records)
        self.fields = Fields.of(self.records, self.data.fields, self.entry.ambiguity_targets, self.entry.secondary_features)
        self.pairing = self.config.pairing_of(self.entry)
        self.links = self.pairing.links(self.entry.target_links)
        if self.links != self.entry.target_links:
            warnings.warn("records paired directly have one link", stacklevel=2)

    @property
    def _blocking(self) -> dict:
        if self.pairing.strategy != "simple-pairs":
            return {}
        return {"neighbours": self.pairing.neighbours, "scope": self.pairing.scope, "max_block_size": self.pairing.max_block_size, "stopwords": self.config.stop_words}

    def seeds(self, min_score: float | None = None) -> DataFrame:
        found = P.seeds(self.records, self.fields, self.pairing.strategy, min_score, self.links, **self._blocking)
        order = ["home_cluster", "home_ref", "target_ref"]
        if label_kind(self.records) == "integer":
            return integer_labels(found, self.records, order)
        return text_labels(found, self.data.name)

    def bridges(self) -> DataFrame:
        terms = bridge_terms(self.records, self.fields, self.config.stop_words)
        made = B.synthesize(checkpoint(self.seeds(self.min_score)), self.records, self.fields, self.entry.alphas, terms, self.entry.target_floor, self.entry.max_length_ratio)
        return checkpoint(made)

    def variant(self, bridges: DataFrame | None = None) -> B.Variant:
        return B.variant(self.bridges() if bridges is None else bridges, self.records, self.fields, self.entry.alphas)


# fixed values: names that metrics have in profiles, sweeps and metadata
REPORTED = {
    "n_original": "n_original_records",
    "n_singletons": "n_singleton_clusters",
    "targets_per_bridge_avg": "target_clusters_per_bridge_avg",
    "targets_per_bridge_stdev": "target_clusters_per_bridge_stdev",
    "bridges_per_home_avg": "bridges_per_home_cluster_avg",
    "bridges_per_home_stdev": "bridges_per_home_cluster_stdev",
    "bridges_per_target_avg": "bridges_per_target_cluster_avg",
    "bridges_per_target_stdev": "bridges_per_target_cluster_stdev",
    "n_positive": "n_undirected",
    "n_space": "comparison_space_size",
    "n_label0": "n_label0_implicit",
    "imbalance": "neg_pos_imbalance",
    "component_count": "bridge_component_count",
    "component_size_avg": "bridge_component_size_avg",
    "component_size_stdev": "bridge_component_size_stdev",
    "component_largest": "largest_bridge_component_clusters",
    "component_largest_records": "largest_bridge_component_records",
    "component_largest_label2": "largest_bridge_component_label2",
    "split_load": "largest_bridge_component_split_load",
    "share_home_median": "field_share_home_median",
    "share_home_iqr": "field_share_home_iqr",
    "sim_home_median": "field_sim_home_median",
    "sim_home_iqr": "field_sim_home_iqr",
    "sim_target_median": "field_sim_target_median",
    "sim_target_iqr": "field_sim_target_iqr",
    "n_fallback": "n_fallback_values",
    "auc_source_target": "content_auc_source_vs_target",
    "auc_extra_target": "content_auc_extra_vs_target",
    "win_rate": "content_winrate_source_vs_target",
    "source_similarity_avg": "sim_source_avg",
    "source_similarity_stdev": "sim_source_stdev",
    "target_similarity_avg": "sim_target_avg",
    "target_similarity_stdev": "sim_target_stdev",
    "extra_similarity_avg": "sim_extra_avg",
    "extra_similarity_stdev": "sim_extra_stdev",
    "margin_boundary": "margin_theta",
    "n_negatives": "neg_sample_size",
    "negative_similarity_avg": "sim_label0_avg",
    "negative_similarity_stdev": "sim_label0_stdev",
    "auc_label1_label0": "content_auc_label1_vs_label0",
    "auc_label2_label0": "content_auc_label2_vs_label0",
    "detect_feature": "detect_best_feature",
    "detect_auc_best": "detect_auc_best_single",
    "n_empty": "n_empty_fields",
}


def profile(variant: B.Variant, alpha: float, generator: Generator) -> dict:
    """M11. One flat row of a variant: the core metrics, then those enabled, in a fixed order, named as reported."""
    one, options, fields = variant.at(alpha), generator.config.profiling, generator.fields
    clusters = checkpoint(one.clusters.select("ref", "cluster_id"))
    truth = checkpoint(one.directed.select("left", "right", "label"))
    links = truth.filter("label = 2").select(F.col("left").alias("target"), F.col("right").alias("bridge"))
    roles = R.pair_roles(truth)
    values = one.records.select("ref", F.struct(*fields.names).alias("r"))
    joined = roles.join(values.toDF("left", "a"), "left").join(values.toDF("right", "b"), "right")
    scored = checkpoint(joined.withColumn("score", record_similarity([(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields.names])).drop("a", "b"))
    components = checkpoint(R.bridge_components(clusters, links))
    row = R.one_row(
        [
            R.record_metrics(clusters, links), class_metrics(truth, F.lit(clusters.count())), R.component_metrics(components, options.split_ratio),
            R.bridge_text_metrics(one.bridge_log, one.link_log), R.direction_metrics(scored),
        ]
    ).first()
    out = {"dataset": generator.data.name, "alpha": alpha, **row.asDict(), **R.margin_mixture(scored, generator.config.analysis_of(generator.entry).threshold.gmm_restarts)}
    if options.negative_similarity:
        n = round(options.neg_pos_ratio * truth.count())
        negatives = R.sampled_negatives(clusters, truth, n, options.seed).withColumn("label", F.lit(0))
        pairs = negatives.unionByName(truth).join(values.toDF("left", "a"), "left").join(values.toDF("right", "b"), "right")
        out |= R.negative_metrics(checkpoint(pairs.withColumn("score", record_similarity([(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields.names])))).first().asDict()
    if options.surface_baseline or options.synthetic_detectability:
        part = components.select(F.explode("clusters").alias("cluster_id"), "bridge_component")
        own = F.coalesce("bridge_component", -F.col("cluster_id"))
        group = clusters.join(part, "cluster_id", "left").select("ref", own.alias("group"))
        if options.surface_baseline:
            grouped = roles.join(group.toDF("right", "group"), "right")
            out |= R.surface_baseline(checkpoint(R.surface_rows(grouped, one.records, fields.names)), options.cv_folds, options.seed)
        if options.synthetic_detectability:
            made = R.bridges_of(truth).withColumn("b", F.lit(True))
            rows = checkpoint(R.shape_rows(one.records, fields.names).join(group, "ref").join(made, "ref", "left").withColumn("positive", F.coalesce("b", F.lit(False))))
            best = R.best_feature(rows).first()
            out |= {"detect_feature": best.feature, "detect_auc_best": best.auc, "detect_auc_lr": grouped_cv_auc(rows, R.SHAPE, options.cv_folds, options.seed)}
    found = {REPORTED.get(k, k): v for k, v in out.items()}
    one = None if not found["n_bridges"] else 1.0  # a bridge has one home
    found |= {"home_clusters_per_bridge_avg": one, "home_clusters_per_bridge_stdev": None if one is None else 0.0}
    if "detect_best_feature" in found:
        found["detect_best_feature"] = REPORTED.get(found["detect_best_feature"], found["detect_best_feature"])
    return found


def generate(spark: SparkSession, config: AmbiguityConfig, out: str, root: str = ".") -> None:
    """``ambiguity generate``: variants, logs, components and metadata of every dataset."""
    if any(e.min_ambiguity == "auto" for e in config.input_data):
        raise ConfigError("minAmbiguity auto is for analyse; generate needs a number or nothing")
    for entry in config.input_data:
        generator = Generator(load_dataset(spark, entry.dataset, root), entry, config, entry.min_ambiguity)
        variant = generator.variant()
        names = sinks.write_variants(variant, out, generator.data.name, generator.links)
        first = variant.at(entry.alphas[0])
        links = first.directed.filter("label = 2").select(F.col("left").alias("target"), F.col("right").alias("bridge"))
        sinks.write_components(R.bridge_components(first.clusters.select("ref", "cluster_id"), links), f"{out}/{generator.data.name}_components.csv")
        rows = [profile(variant, a, generator) for a in entry.alphas]
        settings = {"min_ambiguity": generator.min_score, "target_floor": entry.target_floor, "target_links": generator.links, "max_length_ratio": entry.max_length_ratio}
        pairing = {"pairing_strategy": generator.pairing.strategy, "pairing_neighbours": generator.pairing.neighbours, "pairing_scope": generator.pairing.scope, "pairing_max_block_size": generator.pairing.max_block_size}
        table = None
        for row, folder in zip(rows, [n for n in names if n.endswith("_dir")], strict=True):
            one = sinks.identity_row(spark, folder.rpartition("/")[2], {"base": generator.data.name, **settings}, pairing, {}).select("*", *[F.lit(v).alias(k) for k, v in row.items() if k != "dataset"])
            table = one if table is None else table.unionByName(one, allowMissingColumns=True)
        kinds = {c: "string" for c, t in table.dtypes if t == "void"}
        sinks.upsert(spark, f"{out}/metadata.parquet", table.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}))


@dataclass
class Threshold:
    """M13. A fitted threshold, and what pairing gives around it."""

    fitted: Mixture
    sweep: DataFrame


def analyse_threshold(generator: Generator) -> Threshold | None:
    """Fit a boundary to all pairing scores and pair at each threshold of the grid; None for fewer than two scores."""
    options = generator.config.analysis_of(generator.entry).threshold
    scores = checkpoint(generator.seeds().select("score"))
    fitted = mixture(scores, restarts=options.gmm_restarts)
    if fitted is None:
        return None
    grid = L.threshold_grid(fitted.boundary, options.start_value, options.step_count, options.step_size)
    if generator.pairing.strategy == "greedy-cluster-reps":
        found = P.greedy_summaries(generator.records, generator.fields, grid, generator.links)
    else:
        seeds = checkpoint(generator.seeds())
        found = None
        for t in grid:
            one = P.summary(seeds.filter(F.col("score") >= t)).withColumn("threshold", F.lit(float(t)))
            found = one if found is None else found.unionByName(one)
    n = generator.records.select("cluster_id").distinct().count()
    sweep = found.select(F.lit(generator.data.name).alias("dataset"), "threshold", "bridge_count", "link_count", "short_bridge_count", F.lit(generator.links).cast("long").alias("target_links"), F.lit(n).cast("long").alias("cluster_count"))
    return Threshold(fitted, sweep)


def analyse(spark: SparkSession, config: AmbiguityConfig, out: str, root: str = ".") -> bool:
    """``ambiguity analyse``: threshold and alpha sweeps, the alpha of each criterion, and report tables. False if nothing could be analysed."""
    for entry in config.input_data:
        config.analysis_of(entry).selection.settings.check(config.profiling.enabled)
    reports: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        reports[name] = df if name not in reports else reports[name].unionByName(df, allowMissingColumns=True)

    for entry in config.input_data:
        generator = Generator(load_dataset(spark, entry.dataset, root), entry, config)
        threshold = analyse_threshold(generator)
        if threshold is None:
            warnings.warn(f"{generator.data.name} has fewer than two scores and is left out", stacklevel=2)
            continue
        generator.min_score = threshold.fitted.boundary if entry.min_ambiguity == "auto" else entry.min_ambiguity
        variant = generator.variant()
        rows = [profile(variant, a, generator) for a in entry.alphas]
        table = checkpoint(_frame(spark, rows))
        settings = config.analysis_of(entry).selection.settings
        choices = checkpoint(L.choose(table, settings))
        fitted = threshold.fitted
        add("threshold_sweep", threshold.sweep)
        add("alpha_sweep", L.sweep_report(table, choices, settings))
        add("threshold_chart", sweep_lines(threshold.sweep, "threshold", ["bridge_count", "link_count", "short_bridge_count"]))
        add("alpha_chart", sweep_lines(table, "alpha", [c for c in ("content_separability", "margin_pi_resolvable", "surface_auc_gap", "detect_auc_lr") if c in table.columns]))
        facts = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"dataset": generator.data.name, "theta": fitted.boundary, "boundary_type": fitted.boundary_type, "genuine_share": fitted.share, "low_mean": fitted.means[0], "high_mean": fitted.means[1]}.items()])
        chosen = choices.select(F.lit(generator.data.name).alias("dataset"), "criterion", "chosen", "n_feasible_alphas", "reason")
        add("methodology", L.methodology(chosen.join(facts, "dataset"), ["dataset", "criterion", "chosen", "n_feasible_alphas", "reason", "theta", "boundary_type", "genuine_share", "low_mean", "high_mean"]))
    if not reports:
        warnings.warn("no dataset could be analysed", stacklevel=2)
    return sinks.write_report(reports, out)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Profile rows as a table; columns without any value are doubles."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    kind = lambda k: next(("string" if isinstance(r[k], str) else "double" if isinstance(r[k], float) else "long" for r in rows if r.get(k) is not None), "string" if k.endswith("_type") else "double")
    kinds = {k: "double" if any(isinstance(r.get(k), float) for r in rows) else kind(k) for k in keys}
    cast = {"double": float, "long": int, "string": str}
    data = [tuple(None if r.get(k) is None else cast[kinds[k]](r[k]) for k in keys) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in kinds.items()))


__all__ = ["Generator", "Threshold", "analyse", "analyse_threshold", "generate", "profile"]
