"""The command line end to end on an eight-record dataset, and configurations."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import config as K
from tessera.cli import main
from tessera.operators.selection import threshold_grid

NAMES = ["John Smith", "Jon Smith", "Mary Jones", "Marie Jones", "Peter Brown", "Pete Brown", "Ann Smith", "Anna Smithson"]


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "ids.csv").write_text("id,name\n" + "".join(f"{k},{n}\n" for k, n in enumerate(NAMES, 1)))
    (data / "mapping.csv").write_text("1,2\n3,4\n5,6\n7,8\n")
    (data / "clusters.csv").write_text("id,source,cluster_id\n" + "".join(f"{k},people,{(k + 1) // 2}\n" for k in range(1, 9)))
    return tmp_path


def dataset(clusters=False):
    out = {"type": "csv", "name": "people", "directory": "data", "sources": [{"fileName": "ids.csv", "idCol": "id", "traits": [{"type": "string", "keys": ["name"]}]}], "pairwiseMapping": {"fileName": "mapping.csv", "leftIdCol": 0, "rightIdCol": 1, "hasHeader": False}}
    return out | ({"clusterMapping": {"fileName": "clusters.csv"}} if clusters else {})


def save(folder, data):
    (folder / "config.json").write_text(json.dumps(data))
    return ["-d", str(folder)]


def test_generate(folder, spark):
    root = save(folder, {"inputData": [{"dataset": dataset(), "ambiguityTargets": ["name"], "alphas": [0.8, 0.5], "targetLinks": 2}]})
    assert main([*root, "ambiguity", "generate", "-c", "config.json", "-O", "out"], spark) == 0
    assert main([*root, "ambiguity", "generate", "-c", "config.json", "-O", "out"], spark) == 0
    names = sorted(p.name for p in (folder / "out").iterdir() if p.name.startswith("amb_"))
    assert names == ["amb_people_a050_k2", "amb_people_a050_k2_dir", "amb_people_a080_k2", "amb_people_a080_k2_dir"]
    read = lambda *p: spark.read.csv(str(folder.joinpath("out", *p)), header=True)
    ids, truth = read("amb_people_a050_k2_dir", "ids.csv"), read("amb_people_a050_k2_dir", "mapping.csv")
    bridges = ids.filter("source = 'ambiguity-generator'")
    assert ids.count() == 11 and sorted(int(r.id) for r in bridges.collect()) == [9, 10, 11]
    assert truth.filter("label = 2").count() == 6 and truth.filter("label = 2 AND right_source <> 'ambiguity-generator'").count() == 0
    assert read("amb_people_a050_k2", "mapping.csv").filter("label <> 1").count() == 0
    meta = spark.read.parquet(str(folder / "out" / "metadata.parquet"))
    assert meta.count() == 2 and meta.agg(F.min("n_bridges")).first()[0] == 3
    # fixed values: names of metrics that readers of the metadata rely on
    names = "n_original_records n_singleton_clusters home_clusters_per_bridge_avg target_clusters_per_bridge_stdev bridges_per_home_cluster_avg bridges_per_target_cluster_avg comparison_space_size n_label0_implicit neg_pos_imbalance bridge_component_count largest_bridge_component_label2 largest_bridge_component_split_load field_sim_home_median field_share_home_iqr n_fallback_values link_ambiguity_avg content_auc_source_vs_target content_separability content_auc_extra_vs_target content_winrate_source_vs_target sim_source_avg sim_target_avg sim_extra_stdev margin_pi_resolvable margin_theta margin_boundary_type"
    assert set(names.split()) <= set(meta.columns)
    log = read("people_link_log.csv")
    assert log.count() == 12 and {"rank", "ambiguity", "target_label"} <= set(log.columns)


def test_analyse(folder, spark):
    entry = {"dataset": dataset(), "ambiguityTargets": ["name"], "alphas": [0.5, 0.8], "minAmbiguity": "auto"}
    root = save(folder, {"inputData": [entry], "analysis": {"threshold": {"stepCount": 3, "gmmRestarts": 3}}})
    assert main([*root, "ambiguity", "generate", "-c", "config.json", "-O", "out"], spark) == 2
    assert main([*root, "ambiguity", "analyse", "-c", "config.json", "--plot-dir", "report"], spark) == 0
    read = lambda name: spark.read.csv(str(folder / "report" / name), header=True)
    assert read("alpha_chart.csv").count() >= 2 and read("threshold_chart.csv").count() >= 9
    assert read("threshold_sweep.csv").count() in (3, 4) and read("alpha_sweep.csv").count() == 2 and read("methodology.csv").count() == 1


def test_simple_pairs(folder, spark):
    entry = {"dataset": dataset(), "ambiguityTargets": ["name"], "alphas": [0.5], "targetLinks": 3, "pairing": {"strategy": "simple-pairs"}}
    root = save(folder, {"inputData": [entry], "profiling": {"negativeSimilarity": True, "surfaceBaseline": True, "syntheticDetectability": True, "cvFolds": 2}})
    with pytest.warns(UserWarning, match="one link"):
        assert main([*root, "ambiguity", "generate", "-c", "config.json", "-O", "out"], spark) == 0
    assert (folder / "out" / "amb_people_a050_dir").exists()
    meta = spark.read.parquet(str(folder / "out" / "metadata.parquet"))
    assert {"neg_sample_size", "sim_label0_avg", "sim_label0_stdev", "content_auc_label1_vs_label0", "surface_auc_full", "surface_auc_gap", "detect_auc_best_single", "detect_best_feature", "detect_auc_lr"} <= set(meta.columns)


def test_evaluate(folder, spark):
    root = save(folder, {"benchmarkData": [{"dataset": dataset(clusters=True), "comparisonSpace": {"fileName": "space.parquet"}}], "matching": [{"name": "cover", "type": "coverage", "match": 0.3}], "clustering": {"algorithms": ["wcc", "markov", "parent-center", "leiden", "spectral"]}})
    run = lambda *a: main([*root, "evaluate", "-f", "config.json", *a, "-R", "out"], spark)
    assert run("matching", "-i", "normal", "-i", "both") == 0 and run("matching", "--skip-existing", "--graph-plots", "charts/graphs", "--plot-dpi", "90") == 0
    assert run("clustering", "--cluster-plots", "charts/clusters") == 0 and run("confusion-matrix") == 0 and run("asymmetry") == 0
    chart = lambda *p: spark.read.parquet(str(folder.joinpath("charts", *p)))
    places, lines = (chart("graphs", "people", "cover", "normal", name) for name in ("places", "lines"))
    assert places.filter("x IS NULL OR y IS NULL").count() == 0 and places.select("ref").distinct().count() == places.count() > 0
    assert lines.count() > 0 and lines.filter("colour IS NULL OR x1 IS NULL").count() == 0
    assert chart("clusters", "people", "cover", "normal", "wcc", "members").count() > 0
    read = lambda name: spark.read.csv(str(folder / "out" / name), header=True)
    stats = {r.algorithm: r for r in read("clustering_stats.csv").collect()}
    assert set(stats) == {"wcc", "markov", "parent-center", "leiden", "spectral"} and float(stats["wcc"].pr) > 0
    assert read("confusion_matrix.csv").count() >= 4 and read("asymmetry/all.csv").count() > 0
    root = save(folder, {"benchmarkData": [{"dataset": dataset(), "comparisonSpace": {"fileName": "space.parquet"}}], "matching": [{"name": "cover", "type": "ditto"}], "clustering": {"algorithms": ["wcc"]}})
    assert run("matching") == 2 and run("clustering") == 2


BASE = {"inputData": [{"dataset": dataset(), "ambiguityTargets": ["name"], "alphas": [0.5]}]}


@pytest.mark.parametrize(
    "change",
    [{"alphas": []}, {"alphas": [1.0]}, {"targetFloor": 2}, {"targetLinks": 0}, {"maxLengthRatio": 0.5}, {"minAmbiguity": "some"}, {"pairing": {"neighbours": 0}}, {"pairing": {"strategy": "x"}}] + [{"analysis": {"selection": s}} for s in ({"criterion": "x"}, {"maxAuc": 0.5}, {"minSeparability": 0.7, "maxAuc": 0.8}, {"targetResolvable": 1.5}, {"maxDetectAuc": 0.4}, 3)] + [{"analysis": {"threshold": {"stepSize": 0.01}}}, {"analysis": {"threshold": {"gmmRestarts": 0}}}],
)
def test_bad_entries(change):
    with pytest.raises(K.ConfigError):
        K.build(K.AmbiguityConfig, {"inputData": [BASE["inputData"][0] | change]})


@pytest.mark.parametrize("change", [{"inputData": []}, {"pairingMaxBlockSize": 1}, {"pairingScope": "x"}, {"profiling": {"cvFolds": 1}}, {"profiling": {"splitRatio": [1, 0, 1]}}, {"profiling": {"negPosRatio": 0}}])
def test_bad_settings(change):
    with pytest.raises(K.ConfigError):
        K.build(K.AmbiguityConfig, BASE | change)


def test_defaults_and_overrides():
    with pytest.warns(UserWarning, match="unknown"):
        got = K.build(K.AmbiguityConfig, BASE | {"unknown": 1, "pairingNeighbours": 3, "analysis": {"selection": {"maxAuc": 0.8}}})
    entry = got.input_data[0]
    assert got.pairing_of(entry) == K.PairingConfig(neighbours=3) and got.analysis_of(entry).selection.max_auc == 0.8 and got.profiling.cv_folds == 5
    over = K.build(K.AmbiguityConfig, {"inputData": [BASE["inputData"][0] | {"pairing": {"pairingScope": "mutual"}, "analysis": {"selection": {"minSeparability": 0.1}}}], "pairingNeighbours": 3, "analysis": {"selection": {"maxAuc": 0.8}}})
    assert over.pairing_of(over.input_data[0]) == K.PairingConfig(neighbours=3, scope="mutual") and over.analysis_of(over.input_data[0]).selection.max_auc == 0.9
    with pytest.raises(K.ConfigError):
        K.build(K.AmbiguityConfig, {})


def entry_with(analysis):
    return K.build(K.AmbiguityConfig, {"inputData": [{"dataset": dataset(), "alphas": [0.65], "analysis": analysis}]})


def test_nested_analysis():
    config = entry_with({"selection": {"criterion": ["surface-gap", "smallest", "surface-gap"], "maxAuc": 0.8}, "threshold": {"stepCount": 3}})
    found = config.analysis_of(config.input_data[0])
    assert (found.selection.settings.criteria, found.selection.max_auc, found.threshold.step_count) == (("surface-gap", "smallest"), 0.8, 3)
    only = entry_with({"threshold": {"stepCount": 3}})
    assert only.analysis_of(only.input_data[0]).selection == K.SelectionConfig() and only.input_data[0].ambiguity_targets == ()
    derived = entry_with({"selection": {"criterion": "smallest"}})
    limits = derived.analysis_of(derived.input_data[0]).threshold
    assert threshold_grid(1.0, limits.start_value, limits.step_count, limits.step_size) == pytest.approx([-4.0 + k for k in range(11)])
    gap = entry_with({"selection": {"criterion": "surface-gap"}})
    with pytest.raises(ValueError, match="surface_baseline"):
        gap.analysis_of(gap.input_data[0]).selection.settings.check(gap.profiling.enabled)
    with pytest.warns(UserWarning, match="criterion"):
        entry_with({"criterion": "surface-gap"})


def test_stop_words_of_the_configuration():
    assert K.build(K.AmbiguityConfig, BASE | {"stopWords": ["The", "of"]}).stop_words == ("the", "of")
