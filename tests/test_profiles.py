"""Profiles of a thirteen-record dataset with known metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning, matching, metrics, selection
from tessera.operators import graphs as G
from tessera.operators import profiles as R

# fixed values: the thirteen records, links and similarities, and the metrics below that are known for them
MEMBERS = {1: ["a1", "a2", "b1"], 2: ["t1", "t2"], 3: ["u1"], 4: ["e1", "b2"], 5: ["f1", "f2", "b3"], 6: ["g1"], 7: ["h1"]}
LINKS = [("t1", "b1"), ("t2", "b1"), ("t1", "b2"), ("u1", "b2"), ("h1", "b3")]
SIMILAR = {("a1", "b1"): 0.9, ("a2", "b1"): 0.7, ("e1", "b2"): 0.6, ("f1", "b3"): 0.2, ("f2", "b3"): 0.4, ("t1", "b1"): 0.3, ("t2", "b1"): 0.5, ("t1", "b2"): 0.8, ("u1", "b2"): 0.6, ("h1", "b3"): 0.4, ("a1", "a2"): 1.0, ("t1", "t2"): 0.1, ("f1", "f2"): 0.5, ("a1", "t2"): 0.95}


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([(m, c) for c, ms in MEMBERS.items() for m in ms], "ref string, cluster_id long")


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LINKS, "target string, bridge string")


@pytest.fixture(scope="module")
def truth(spark):
    within = [(a, b, 1) for ms in MEMBERS.values() for k, a in enumerate(ms) for b in ms[k + 1 :]]
    return spark.createDataFrame(within + [(t, b, 2) for t, b in LINKS], "left string, right string, label int")


def scored(spark, pairs):
    known = SIMILAR | {(b, a): s for (a, b), s in SIMILAR.items()}
    table = spark.createDataFrame([(a, b, s) for (a, b), s in known.items()], "left string, right string, score double")
    return pairs.join(table, ["left", "right"], "left").fillna(0.0, ["score"])


def test_record_metrics(clusters, links):
    r = R.record_metrics(clusters, links).first()
    assert (r.n_records, r.n_original, r.n_bridges, r.n_clusters, r.n_singletons) == (13, 10, 3, 7, 3)
    assert (r.n_home_clusters, r.n_target_clusters, r.n_unbridged_clusters) == (3, 3, 1)
    want = {"bridge_share": 3 / 13, "cluster_size_avg": 13 / 7, "cluster_size_stdev": math.sqrt(34) / 7, "targets_per_bridge_avg": 4 / 3, "targets_per_bridge_stdev": math.sqrt(2) / 3, "bridges_per_home_avg": 3 / 7, "bridges_per_home_stdev": math.sqrt(12) / 7, "bridges_per_target_avg": 4 / 7, "bridges_per_target_stdev": math.sqrt(26) / 7}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_class_metrics(truth):
    r = metrics.class_metrics(truth, F.lit(13)).first()
    assert (r.n_label1, r.n_label2, r.n_positive, r.n_space, r.n_label0) == (8, 5, 13, 78, 65)
    assert (r.positive_rate, r.imbalance, r.match_bridge_ratio) == pytest.approx((1 / 6, 5.0, 1.6))


def test_components(clusters, links):
    found = R.bridge_components(clusters, links)
    assert [(r.clusters, r.n_records, r.n_bridges, r.n_label2) for r in found.orderBy("bridge_component").collect()] == [([1, 2, 3, 4], 8, 2, 4), ([5, 7], 4, 1, 1)]
    r = R.component_metrics(found).first()
    assert (r.component_count, r.component_size_avg, r.component_size_stdev, r.split_load) == pytest.approx((2, 3.0, 1.0, 4.0))
    assert R.component_metrics(found, (1, 1)).first().split_load == pytest.approx(1.6)
    none = R.component_metrics(R.bridge_components(clusters, links.limit(0))).first()
    assert none.component_count == 0 and none.component_size_avg is None and none.split_load is None


def test_direction(spark, truth):
    rows = scored(spark, R.pair_roles(truth))
    r = R.direction_metrics(rows).first()
    assert (r.auc_source_target, r.content_separability, r.auc_extra_target, r.win_rate) == pytest.approx((0.56, 0.12, 0.5, 1 / 3))
    m = R.margin_mixture(rows)
    assert m["margin_pi_resolvable"] == pytest.approx(1 / 3, abs=1e-3) and 0.1 < m["margin_boundary"] < 0.4 and m["margin_boundary_type"] == learning.BAYES
    assert set(R.margin_mixture(rows.filter("right = 'b1'")).values()) == {None}


def test_roles_and_unknown_labels(spark, truth):
    roles = {(r.left, r.right): r.role for r in R.pair_roles(truth).collect()}
    assert roles["a1", "b1"] == "source" and roles["t1", "b1"] == "target" and roles["a1", "a2"] == "extra" and len(roles) == 13
    with pytest.raises(Exception, match="unexpected pair label"):
        R.pair_roles(truth.withColumn("label", F.lit(5))).collect()


def test_negatives(spark, clusters, truth):
    negatives = R.sampled_negatives(clusters, truth, 1000).withColumn("label", F.lit(0))
    rows = scored(spark, negatives.unionByName(truth))
    r = R.negative_metrics(rows).first()
    assert (r.n_negatives, r.negative_similarity_avg, r.auc_label1_label0, r.auc_label2_label0) == pytest.approx((65, 0.95 / 65, 513 / 520, 320 / 325))
    few = R.sampled_negatives(clusters, truth, 7)
    assert sorted(few.collect()) == sorted(R.sampled_negatives(clusters, truth, 7).collect()) and few.count() == 7


def test_bridge_text(spark):
    log = spark.createDataFrame([(0.6, 0.6, 0.4, "x", "x", False), (0.5, 0.5, 0.5, "y", "z", False), (None, None, None, "w", "w", True), (0.8, 0.8, 0.2, "v", "v", False)], "share_home double, sim_home double, sim_target double, value string, value_no_floor string, fallback boolean")
    ambiguity = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "ambiguity double")
    r = R.bridge_text_metrics(log, ambiguity).first()
    want = {"share_home_median": 0.6, "sim_home_median": 0.6, "sim_target_median": 0.4, "share_home_iqr": 0.15, "sim_home_iqr": 0.15, "sim_target_iqr": 0.15, "n_fallback": 1, "floor_changed_share": 0.25, "link_ambiguity_avg": 4.0, "link_ambiguity_stdev": math.sqrt(8 / 3)}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_surface_baseline(spark):
    records, pairs = [], []
    for k in range(8):
        n = 4 + k % 2
        own = [f"w{k}_{i}" for i in range(n)]
        records += [(f"b{k}", " ".join(own)), (f"h{k}", " ".join([*own, f"x{k}"])), (f"t{k}", " ".join(own[:-1]))]
        pairs += [(f"h{k}", f"b{k}", "source", k // 2), (f"t{k}", f"b{k}", "target", k // 2)]
    rows = R.surface_rows(spark.createDataFrame(pairs, "left string, right string, role string, group int"), spark.createDataFrame(records, "ref string, name string"), ["name"])
    found = R.surface_baseline(rows, folds=4)
    assert found["surface_auc_full"] == pytest.approx(1.0) and found["surface_auc_symmetric"] < 1 and found["surface_auc_gap"] == pytest.approx(1 - found["surface_auc_symmetric"])
    assert R.surface_baseline(rows, folds=5)["surface_auc_full"] is None


def test_mixture(spark):
    rows = spark.createDataFrame([(x,) for x in [0.0, 0.1, -0.1] * 5 + [10.0, 10.1, 9.9] * 5], "score double")
    m = learning.mixture(rows)
    assert m.share == pytest.approx(0.5, abs=1e-6) and m.means == pytest.approx((0, 10), abs=1e-3) and m.boundary == pytest.approx(5, abs=1e-3) and m.boundary_type == learning.BAYES
    assert learning.mixture(rows.limit(1)) is None and learning.mixture(rows.limit(0)) is None


def test_mixture_of_many_scores_is_that_of_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0.01, 0.004, 700), rng.normal(0.03, 0.006, 300)])
    rows = spark.createDataFrame([(float(x),) for x in values], "score double").repartition(5)
    near = learning.mixture(rows, restarts=5)
    monkeypatch.setattr(learning, "MOST_ROWS", 50)
    monkeypatch.setattr(learning, "CHUNK", 64)
    far = learning.mixture(rows, restarts=5)
    assert (far.boundary, far.share, *far.means, *far.deviations) == pytest.approx((near.boundary, near.share, *near.means, *near.deviations), rel=1e-6)
    assert near.means == pytest.approx((0.01, 0.03), abs=0.003) and near.boundary_type == learning.BAYES


def test_drawn_negatives(spark, monkeypatch):
    """Few of many pairs are drawn; as many as asked for, none twice, none positive; also where nearly all records share a cluster."""
    for size, n in ((lambda k: k // 3, 400), (lambda k: 0 if k < 180 else k, 300)):
        clusters = spark.createDataFrame([(f"r{k:03}", size(k)) for k in range(200)], "ref string, cluster_id long")
        truth = spark.createDataFrame([(f"r{k:03}", f"r{(k * 7 + 1) % 200:03}") for k in range(200) if k != (k * 7 + 1) % 200], "left string, right string")
        of = {r.ref: r.cluster_id for r in clusters.collect()}
        true = {frozenset(r) for r in truth.collect()}
        got = [tuple(r) for r in R.sampled_negatives(clusters, truth, n).collect()]
        assert len(got) == len(set(got)) == n
        assert all(a < b and of[a] != of[b] and frozenset((a, b)) not in true for a, b in got)
        assert sorted(got) == sorted(tuple(r) for r in R.sampled_negatives(clusters.repartition(3), truth, n).collect())
        every = R.sampled_negatives(clusters, truth, 10**6).collect()
        assert len(every) == sum(of[a] != of[b] and frozenset((a, b)) not in true for a in of for b in of if a < b)


SWEEP = [(0.5, 0.1), (0.65, 0.3), (0.8, 0.5), (0.95, 0.9)]


def test_selection(spark):
    rows = spark.createDataFrame([(a, s, p, b, g, d) for (a, s), p, b, g, d in zip(SWEEP, [0.5, None, 0.2, 0.5], ["bayes_optimal"] * 4, [0.9, 0.2, 0.4, 0.9], [0.1, 0.6, 0.9, None], strict=True)], "alpha double, content_separability double, margin_pi_resolvable double, margin_boundary_type string, surface_auc_gap double, detect_auc_lr double")
    every = selection.Settings(criteria=("smallest", "gmm-balance", "surface-gap", "order-headroom"))
    found = {r.criterion: (r.chosen, r.n_feasible_alphas, r.reason) for r in selection.choose(rows, every).collect()}
    assert found == {"smallest": (0.65, 2, None), "gmm-balance": (0.8, 2, None), "surface-gap": (0.8, 2, None), "order-headroom": (0.65, 2, None)}
    none = {r.criterion: r.reason for r in selection.choose(rows.filter("alpha < 0.6"), every).collect()}
    assert set(none.values()) == {"no_feasible_alpha"}
    with pytest.raises(ValueError):
        selection.Settings(criteria=("other",))
    with pytest.raises(ValueError):
        every.check([])
    assert selection.threshold_grid(2.5, count=3) == [-2.5, -1.5, -0.5, 2.5] and len(selection.threshold_grid(0.0)) == 11


LABELS = {(0, 0): (0, 0), (0, 1): (1, 1), (0, 2): (0, 2), (1, 0): (1, 1), (1, 1): (1, 1), (1, 2): (1, 2), (2, 0): (2, 0), (2, 1): (1, 1), (2, 2): (2, 2)}


@pytest.mark.parametrize(("given", "stored"), LABELS.items())
def test_match_labels(spark, given, stored):
    weights = [0.1, 0.2, 0.7]
    rows = spark.createDataFrame([(0, "x", "y", given[0], weights), (1, "y", "x", given[1], weights)], "seq int, left string, right string, label int, label_weights array<double>")
    graph = {(r.src, r.dst): r.label for r in G.match_graph(rows).collect()}
    assert (graph.get(("x", "y"), 0), graph.get(("y", "x"), 0)) == stored
    flat = {(r.src, r.dst): (r.label, r.weight) for r in G.match_graph(rows, degrade=True).collect()}
    want = {("x", "y"), ("y", "x")} if any(given) else set()
    assert set(flat) == want and all(v == (1, pytest.approx(0.875)) for v in flat.values())


def test_degraded_weights_nearly_even(spark):
    rows = spark.createDataFrame([(0, "x", "y", 1, [0.34, 0.33, 0.33])], "seq int, left string, right string, label int, label_weights array<double>")
    assert matching.degrade_results(rows).first().label_weights[1] == pytest.approx(0.34 / 0.67)


def test_edge_classes_and_cluster_matches(spark):
    p, t = spark.createDataFrame([("b", "a")], "src string, dst string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    count = lambda o: {r.status: r.n for r in G.status_counts(G.classify_edges(p, t, o)).collect()}
    assert count(False) == {"TP": 1} and count(True) == {"FP": 1, "FN": 1}
    true = spark.createDataFrame([(k, 1 if k < 2 else 2) for k in range(5)], "ref int, cluster_id long")
    one = spark.createDataFrame([(k, 9) for k in range(5)], "ref int, cluster_id long")
    assert [tuple(r) for r in metrics.best_cluster_matches(true, one).collect()] == [(2, 9, 3)]


def test_cluster_matches_are_the_best(spark):
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(4):
        a = spark.createDataFrame([(k, rng.randrange(4)) for k in range(40)], "ref int, cluster_id long")
        b = spark.createDataFrame([(k, rng.randrange(5)) for k in range(40)], "ref int, cluster_id long")
        cells = {(r.t, r.p): r.n for r in metrics.contingency(a, b).collect()}
        best = max(sum(cells.get((t, p), 0) for t, p in zip(range(4), order, strict=True)) for order in itertools.permutations(range(5), 4))
        assert sum(r.n for r in metrics.best_cluster_matches(a, b).collect()) == best


def test_stale_graphs(spark):
    refs = spark.createDataFrame([(k,) for k in range(5)], "ref int")
    asked = spark.createDataFrame([(0, 1), (1, 2), (3, 2)], "left int, right int")
    edges = spark.createDataFrame([(1, 0), (2, 3)], "src int, dst int")
    assert tuple(G.staleness(refs, edges, refs, asked).first()) == (0, 0, 0)
    odd = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 9)], "ref int")
    assert tuple(G.staleness(odd, edges.union(spark.createDataFrame([(0, 4)], "src int, dst int")), refs, asked).first()) == (1, 1, 1)
