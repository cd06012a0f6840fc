"""Queries over bridges between clusters of parts, and over the models and clusterings that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import record_similarity
from ..operators import bridges as B
from ..operators import clustering as K
from ..operators import graphs as G
from ..operators import learning as N
from ..operators import metrics as M
from ..operators import pairing as P
from ..operators import profiles as R
from ..operators import records as D
from ..operators import selection as L
from ..operators.matching import is_bridge
from ..runtime import checkpoint, table
from ..sources import sinks
from ..sources.tables import row_count
from .er import COMPARED, GRAPH, PARTS, SCORE, by_label, clusterings, compared, edges_sql, lev, marked_truth, matched, parts, query, r6

ALPHAS = (0.5, 0.8)


def bridged(spark: SparkSession, sf_dir: str, targets: tuple[str, ...] = ("p_name",)) -> tuple[DataFrame, DataFrame, D.Fields]:
    """Bridges of greedy pairing between parts' clusters, with their records and fields; ``targets`` are synthesised."""
    records, paired = parts(spark, sf_dir)
    seeds = D.integer_labels(checkpoint(P.greedy_seeds(records, paired, links=2)), records, ["home_cluster"])
    fields = D.Fields.of(records, paired.names, targets=targets, secondary=("p_size",))
    return B.synthesize(seeds, records, fields, ALPHAS, ["deluxe"], target_floor=0.5), records, fields


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(f"{c}.label") for c, t in df.dtypes if t.startswith("struct<source")})


SEEDS = f"""{edges_sql(2)}, picked AS (SELECT home, target, row_number() OVER (PARTITION BY home ORDER BY score DESC, target) AS n FROM edges WHERE target > home),
sd AS (SELECT home, target, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY home) AS bridge, h.id AS hid, t.id AS tid FROM picked JOIN ranked h ON h.cluster_id = home AND h.rank = 0 JOIN ranked t ON t.cluster_id = target AND t.rank = 0 WHERE n = 1),
lk AS (SELECT bridge, id AS target_id, rank FROM sd JOIN ranked ON cluster_id = target AND rank < 2), al AS (SELECT unnest([0.5, 0.8]::DOUBLE[]) AS alpha)"""


@query("b1_bridge_records", f"""WITH {SEEDS} SELECT alpha, bridge AS id, CASE WHEN h.p_brand = t.p_brand THEN h.p_brand ELSE '' END AS p_brand, CASE WHEN h.p_type = t.p_type THEN h.p_type ELSE '' END AS p_type, nullif(h.p_size, 0) AS p_size, h.p_name <> t.p_name AS name_is_new
FROM sd JOIN rec h ON h.id = hid JOIN rec t ON t.id = tid CROSS JOIN al""")
def b1(spark, sf_dir):
    made, records, _ = bridged(spark, sf_dir)
    names = records.select("ref", "p_name")
    rows = made.join(names.toDF("home_ref", "hn"), "home_ref").join(names.toDF("target_ref", "tn"), "target_ref")
    new = (F.col("fields.p_name") != F.col("hn")) & (F.col("fields.p_name") != F.col("tn"))
    return rows.select("alpha", F.col("bridge.label").alias("id"), "fields.p_brand", "fields.p_type", "fields.p_size", new.alias("name_is_new"))


@query("b2_bridge_log")
def b2(spark, sf_dir):
    return B.bridge_log(bridged(spark, sf_dir)[0])


@query("b1_bridge_texts")
def b1_texts(spark, sf_dir):
    made = bridged(spark, sf_dir)[0]
    return made.select("alpha", F.col("bridge.label").alias("id"), "fields.*")


@query("g7_link_log")
def g7(spark, sf_dir):
    return B.link_log(*bridged(spark, sf_dir))


@query("g7_untargeted_link_log", f"""WITH {SEEDS} SELECT alpha, lk.bridge AS bridge_label, target AS target_cluster, target_id AS target_label, CAST(rank AS INT) AS rank,
  CAST(round(CASE WHEN h.p_name = t.p_name THEN CASE WHEN r.p_name = h.p_name THEN 2.0 ELSE -0.5 END WHEN r.p_name = '' THEN 2.0 ELSE -0.5 END
  + CASE WHEN h.p_brand = t.p_brand AND r.p_brand = h.p_brand THEN 2.0 ELSE -0.5 END + CASE WHEN h.p_type = t.p_type AND r.p_type = h.p_type THEN 2.0 ELSE -0.5 END
  + CASE WHEN h.p_size = 0 THEN -0.5 WHEN r.p_size = h.p_size THEN 2.0 ELSE -1.0 END - 1.5, 6) AS DOUBLE) AS ambiguity
FROM lk JOIN sd ON sd.bridge = lk.bridge JOIN rec h ON h.id = hid JOIN rec t ON t.id = tid JOIN rec r ON r.id = target_id CROSS JOIN al""")
def g7_untargeted(spark, sf_dir):
    """Links of bridges whose texts that differ are left empty, so that the ambiguity follows from the records alone."""
    return B.link_log(*bridged(spark, sf_dir, targets=())).withColumn("ambiguity", r6("ambiguity"))


@query("g6_cluster_truth", f"WITH {SEEDS} SELECT alpha, cluster_id, count(*) AS n, min(CASE WHEN b THEN id END) AS bridge FROM (SELECT id, cluster_id, false AS b FROM rec UNION ALL SELECT bridge, home, true FROM sd) CROSS JOIN al GROUP BY alpha, cluster_id")
def g6(spark, sf_dir):
    variant = B.variant(*bridged(spark, sf_dir), ALPHAS)
    return variant.clusters.groupBy("alpha", "cluster_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("is_bridge"), F.col("ref.label"))).alias("bridge"))


@query("u2_variant_truth", f"""WITH {SEEDS}, cl AS (SELECT id, cluster_id, 0 AS b FROM rec UNION ALL SELECT bridge, home, 1 FROM sd) SELECT alpha, l AS left_id, r AS right_id, label FROM (
  SELECT x.id AS l, y.id AS r, 1 AS label FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.id < y.id UNION ALL SELECT target_id, bridge, 2 FROM lk) CROSS JOIN al""")
def u2_variant(spark, sf_dir):
    return labelled(B.variant(*bridged(spark, sf_dir), ALPHAS).directed).select("alpha", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "label")


@query("k2_variant_ids", f"WITH {SEEDS} SELECT alpha, source, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM (SELECT 'part' AS source, p_size FROM rec UNION ALL SELECT 'ambiguity-generator', nullif(h.p_size, 0) FROM sd JOIN rec h ON h.id = hid) CROSS JOIN al GROUP BY alpha, source")
def k2(spark, sf_dir):
    ids = sinks.ids_frame(B.variant(*bridged(spark, sf_dir), ALPHAS).records)
    return ids.groupBy("alpha", "source").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("k3_cluster_frame", f"WITH {PARTS} SELECT id, 'part' AS source, cluster_id FROM rec")
def k3(spark, sf_dir):
    return sinks.cluster_frame(parts(spark, sf_dir)[0])


@query("a25_secondary_counts", f"WITH {SEEDS} SELECT 'p_size' AS field, count(CASE WHEN h.p_size <> 0 THEN 1 END) AS copied, count(CASE WHEN h.p_size = 0 THEN 1 END) AS missing, count(CASE WHEN h.p_size <> 0 AND h.p_size = t.p_size THEN 1 END) AS equal FROM sd JOIN rec h ON h.id = hid JOIN rec t ON t.id = tid")
def a25(spark, sf_dir):
    records, fields = parts(spark, sf_dir)
    return D.secondary_counts(P.greedy_seeds(records, fields, links=2), records, D.Fields.of(records, fields.names, secondary=("p_size",)))


@query("a11_bridge_text_metrics")
def a11(spark, sf_dir):
    made, records, fields = bridged(spark, sf_dir)
    made = checkpoint(made)
    return R.bridge_text_metrics(B.bridge_log(made), B.link_log(made, records, fields))


@query("m4_margin_mixture")
def m4(spark, sf_dir):
    from ..operators.scoring import record, score_carried

    _, fields = parts(spark, sf_dir)
    found = R.margin_mixture(score_carried(R.pair_roles(marked_truth(spark, sf_dir, record(fields)), ["values"]), fields))
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in found.items()])


@query("m1_m2_score_mixture")
def m1(spark, sf_dir):
    fitted = N.mixture(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("score")))
    return spark.createDataFrame([(fitted.boundary, fitted.boundary_type, fitted.share)], "boundary double, boundary_type string, share double")


@query("m6_enough_groups", "WITH g AS (SELECT s_acctbal > 5000 AS p, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1) SELECT count(*) = 2 AND min(n) >= 5 AS enough FROM g")
def m6(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 5000).alias("positive"), F.col("s_nationkey").alias("group"))
    return spark.range(1).select(F.lit(N.enough_groups(rows, 5)).alias("enough"))


@query("m7_surface_baseline")
def m7(spark, sf_dir):
    records, fields = parts(spark, sf_dir)
    truth = marked_truth(spark, sf_dir, R.surface_tokens(fields.names)).withColumnRenamed("cluster_id", "group")
    found = R.surface_baseline(R.surface_rows(R.pair_roles(truth, ["values"], ["group"]), records, fields.names))
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in found.items()])


@query("m8_detectability")
def m8(spark, sf_dir):
    records, fields = parts(spark, sf_dir)
    rows = R.shape_rows(records, fields.names).join(records.select("ref", F.col("cluster_id").alias("group"), (F.col("p_size") % 7 == 0).alias("positive")), "ref")
    return spark.range(1).select(F.lit(N.grouped_cv_auc(checkpoint(rows), R.SHAPE)).cast("double").alias("auc"))


@query("p7_m9_negatives", """WITH t AS (SELECT a.s_suppkey AS l, b.s_suppkey AS r FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE floor(a.s_acctbal / 1000) = floor(b.s_acctbal / 1000))
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey <> b.s_nationkey WHERE NOT EXISTS (SELECT 1 FROM t WHERE l = a.s_suppkey AND r = b.s_suppkey)""")
def p7(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("cluster_id"), F.floor(F.col("s_acctbal") / 1000).alias("k"))
    n = rows.count()
    return R.sampled_negatives(rows.select("ref", "cluster_id"), rows.select("ref", F.col("k").alias("group")), n * n).toDF("left_id", "right_id")


@query("f5_record_similarity")
def f5(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select(F.col("p_partkey").alias("id"), r6(record_similarity([(F.col("p_name"), F.col("p_type")), (F.col("p_brand"), F.col("p_name"))])).alias("similarity"))


def _graph(spark, sf_dir):
    """Edges of the matcher whose label is a full match, with weights from the pair's ids, over all parts."""
    rows = compared(spark, sf_dir)[1].filter("same_type")
    edges = rows.select(F.col("left").alias("src"), F.col("right").alias("dst"), ((F.col("left") + F.col("right")) % 7 / 7 + 0.1).alias("weight"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")), edges


@query("e5_components_clustering", f"""WITH RECURSIVE {COMPARED}, few AS (SELECT l, r FROM tru WHERE (SELECT p_type FROM part WHERE p_partkey = l) = (SELECT p_type FROM part WHERE p_partkey = r)), b AS (SELECT l, r FROM few UNION SELECT r, l FROM few), w AS (SELECT p_partkey AS id, p_partkey AS seen FROM part UNION SELECT w.id, b.r FROM w JOIN b ON w.seen = b.l), k AS (SELECT id, min(seen) AS least FROM w GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY least) AS cluster_id FROM k""")
def e5(spark, sf_dir):
    return K.cluster(*_graph(spark, sf_dir), "wcc").select(F.col("ref").alias("id"), "cluster_id")


def _register(name: str, algorithm: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        return K.cluster(*_graph(spark, sf_dir), algorithm).select(F.col("ref").alias("id"), "cluster_id")


for _name, _algorithm in (("e6_markov", "markov"), ("e7_parent_center", "parent-center"), ("e8_leiden", "leiden"), ("e8_spectral", "spectral")):
    _register(_name, _algorithm)


@query("v2_cluster_matches")
def v2(spark, sf_dir):
    true, predicted = clusterings(spark, sf_dir)
    number = lambda c: D.number_clusters(c.withColumnRenamed("cluster_id", "key"), "key").drop("key")
    return M.best_cluster_matches(number(true), number(predicted))


@query("v6_prediction_nodes")
def v6(spark, sf_dir):
    true, predicted = clusterings(spark, sf_dir)
    number = lambda c: checkpoint(D.number_clusters(c.withColumnRenamed("cluster_id", "key"), "key").drop("key"))
    t, p = number(true), number(predicted)
    return labelled(G.prediction_nodes(t, p, M.best_cluster_matches(t, p)))


@query("a28_cluster_count", f"WITH {PARTS} SELECT count(DISTINCT cluster_id) AS n FROM rec")
def a28(spark, sf_dir):
    return D.cluster_count(parts(spark, sf_dir)[0])


@query("s6_row_count", "SELECT count(*) AS n FROM lineitem")
def s6(spark, sf_dir):
    return spark.range(1).select(F.lit(row_count(spark, f"{sf_dir}/lineitem.parquet")).alias("n"))


@query("p6_bridge_sources", f"WITH {SEEDS} SELECT is_bridge, count(*) AS n FROM (SELECT false AS is_bridge FROM rec UNION ALL SELECT true FROM sd) GROUP BY is_bridge")
def p6(spark, sf_dir):
    ids = B.variant(*bridged(spark, sf_dir), ALPHAS).at(0.5).records
    return ids.groupBy(is_bridge(F.col("ref"), D.BRIDGE_SOURCE).alias("is_bridge")).agg(F.count("*").alias("n"))


@query("u4_unordered_pairs", f"WITH {COMPARED} SELECT DISTINCT least(l, r) AS left_id, greatest(l, r) AS right_id FROM cmp")
def u4(spark, sf_dir):
    return compared(spark, sf_dir)[0].select(*M.unordered()).distinct().toDF("left_id", "right_id")


@query("v1_merged_edges", f"""WITH {GRAPH}, x AS (SELECT coalesce(g.src, t.l) AS l, coalesce(g.dst, t.r) AS r, CASE WHEN g.src IS NOT NULL AND t.l IS NOT NULL THEN 'TP' WHEN g.src IS NOT NULL THEN 'FP' ELSE 'FN' END AS status FROM graph g FULL JOIN tru t ON g.src = t.l AND g.dst = t.r)
SELECT least(l, r) AS left_id, greatest(l, r) AS right_id, status, count(*) > 1 AS both_ways FROM x GROUP BY 1, 2, 3""")
def v1_merged(spark, sf_dir):
    results, _, true = matched(spark, sf_dir)
    merged = G.merge_reciprocal(G.classify_edges(G.match_graph(results), true.select(F.col("left").alias("src"), F.col("right").alias("dst")), ordered=True))
    return merged.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "status", "both_ways")


@query("f24_degraded_graph", f"""WITH {COMPARED}, tk AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), s AS (SELECT l, r, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS na, len(b.t) AS nb FROM cmp JOIN tk a ON a.id = l JOIN tk b ON b.id = r),
lab AS (SELECT l, r FROM s WHERE least(s / na::DOUBLE, s / nb::DOUBLE) >= 0.6 OR s / na::DOUBLE >= 0.3) SELECT l AS src, r AS dst FROM lab UNION SELECT r, l FROM lab""")
def f24_graph(spark, sf_dir):
    return G.match_graph(matched(spark, sf_dir)[0], degrade=True).select("src", "dst")


@query("m12_sweep_report", """WITH sw AS (SELECT s_suppkey / 100.0::DOUBLE AS alpha, s_acctbal / 10000.0 AS content_separability FROM supplier), fe AS (SELECT *, coalesce(content_separability BETWEEN 0.2 AND 0.8, false) AS feasible FROM sw)
SELECT alpha, feasible, CASE WHEN alpha = (SELECT min(alpha) FROM fe WHERE feasible) THEN 'smallest' END AS chosen_by FROM fe""")
def m12(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") / 100).alias("alpha"), (F.col("s_acctbal") / 10000).alias("content_separability"))
    return L.sweep_report(rows, L.choose(rows, L.Settings()), L.Settings()).select("alpha", "feasible", "chosen_by")


BOUND = SCORE.replace(lev("lower(a.p_name)", "lower(b.p_name)"), "(least(length(a.p_name), length(b.p_name)) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE))")


@query("f7_bound", f"WITH {PARTS} SELECT a.id AS left_id, b.id AS right_id, CAST(round({BOUND}, 6) AS DOUBLE) AS bound, {BOUND} >= {SCORE} - 1e-9 AS holds FROM rec a JOIN rec b ON a.cluster_id = b.cluster_id AND a.id < b.id")
def f7_bound(spark, sf_dir):
    from ..operators.scoring import at_places, scored_pairs

    records, fields = parts(spark, sf_dir)
    rows = scored_pairs(by_label(records), fields, {"bound": True, "score": False})
    return rows.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), at_places(F.col("bound"), 6).alias("bound"), (F.col("bound") >= F.col("score") - 1e-9).alias("holds"))
