"""Registered queries over whole tables, against brute force on small ones."""

from collections import defaultdict
from itertools import combinations

import pytest

from tessera.plans import catalog

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Twelve copies over three sources, a pair with tokens of its own, and a token of 101 documents, which is over the bound."""
    texts = ["alpha beta"] * 12 + ["gamma delta"] * 2 + ["common"] * 101
    at = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    blocks = defaultdict(list)
    for k, t in enumerate(texts):
        for token in t.split():
            blocks[token].append(k)
    pairs = defaultdict(float)
    for ids in blocks.values():
        if 2 <= len(ids) <= 100:
            for x, y in combinations(ids, 2):
                if x % 3 != y % 3:
                    pairs[x, y] += 2 / (len(ids) * (len(ids) - 1))
    by_id = defaultdict(list)
    for (x, y), w in pairs.items():
        by_id[x].append((-round(w, 12), y))
        by_id[y].append((-round(w, 12), x))
    top = {(x, y) for x, found in by_id.items() for _, y in sorted(found)[:2]}
    return at, pairs, top


def test_blocks_of_more_than_ten(spark, copies):
    at, pairs, top = copies
    assert {(r.left_id, r.right_id): r.weight for r in QUERIES["j5_block_pairs"](spark, at).collect()} == {k: round(w, 6) for k, w in pairs.items()}
    assert {(r.id, r.partner) for r in QUERIES["w4_top_partners"](spark, at).collect()} == top
    for name, test in (("g1_token_blocking", any), ("j12_mutual_blocking", all)):
        got = {tuple(sorted((r.home, r.target))) for r in QUERIES[name](spark, at).collect()}
        assert got == {(x, y) for x, y in pairs if test([(x, y) in top, (y, x) in top])} and len(got) > 2


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """Line items of small quantities and discounts only; suppliers 1 and 2 are bridges 20 and 40."""
    at = str(tmp_path_factory.mktemp("items"))
    kind = {k: f"t{k % 4}" for k in range(1, 45)}
    links = [(k, 1 + k % 2) for k in range(1, 13)] + [(3, 1), (43, 900)]
    spark.createDataFrame([(k, f"name {k}", "b", 1, t) for k, t in kind.items()], "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(p, s, 1.0, 0.0) for p, s in links], "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{at}/lineitem.parquet")
    return at, links, kind


def united(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(root(x), root(y))] = min(root(x), root(y))
    return {x: root(x) for x in list(parent)}


def test_components_of_all_line_items(spark, items):
    at, links, _ = items
    got = {r.node: r.component for r in QUERIES["g8_components"](spark, at).collect()}
    assert got == united((p, s + 1000000) for p, s in links) and len(set(got.values())) == 2


def test_bridges_of_all_line_items(spark, items):
    at, links, kind = items
    made = {(p, s * 20) for p, s in links if s * 20 in kind and p != s * 20}
    feet = {b: ({kind[p] for p, x in made if x == b}, sum(x == b for _, x in made)) for b in {b for _, b in made}}
    assert {r.bridge: (r.n_targets, r.n_links) for r in QUERIES["a9_footprints"](spark, at).collect()} == {b: (len(t), n) for b, (t, n) in feet.items()}
    parts = united((kind[b], t) for b, (found, _) in feet.items() for t in found)
    w8, a10 = QUERIES["w8_bridge_components"](spark, at).collect(), QUERIES["a10_component_metrics"](spark, at).first()
    assert len(w8) == a10.component_count == len(set(parts.values())) and sum(r.n_label2 for r in w8) == len(made) and sum(r.n_bridges for r in w8) == len(feet)
    a7 = QUERIES["a7_a8_bridged_clusters"](spark, at).first()
    assert a7.n_home_clusters == len({kind[b] for b in feet}) and a7.n_target_clusters == len({t for found, _ in feet.values() for t in found})
    assert {(r.left_id, r.right_id) for r in QUERIES["u2_directed_truth"](spark, at).collect() if r.label == 2} == made


def test_score_mixture_starts_as_often_as_by_default(spark, smoke_dir, monkeypatch):
    from tessera.operators import learning

    seen, fit = [], learning.fit_mixture
    monkeypatch.setattr(learning, "fit_mixture", lambda counted, restarts: seen.append(restarts) or fit(counted, restarts))
    assert QUERIES["m1_m2_score_mixture"](spark, smoke_dir).count() == 1 and seen == [50]


@pytest.mark.parametrize("name", ["f7_ambiguity", "f7_bound", "g9_pair_roles", "k2_k4_frames"])
def test_pairs_are_not_exchanged(spark, smoke_dir, name):
    """The join of blocks comes last: nothing of the size of the pairs is shuffled after it."""
    plan = QUERIES[name](spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.split("\n") if "Join " in line or "Aggregate" in line)
    assert "__i#" in last and "__j#" in last


@pytest.mark.parametrize("name", ["m4_margin_mixture", "m7_surface_baseline", "m10_direction_metrics"])
def test_pairs_are_not_written(spark, small_dir, monkeypatch, name):
    """What is kept of the pairs are counts and means, fewer rows than there are pairs."""
    held, kept = type(spark.range(1)).checkpoint, []
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **b: kept.append(df.count()) or held(df, *a, **b))
    assert QUERIES[name](spark, small_dir).count() == 1
    assert max(kept) < QUERIES["j3_cluster_pairs"](spark, small_dir).count() / 2


@pytest.mark.parametrize("name", ["u2_directed_truth", "u2_variant_truth"])
def test_true_pairs_are_not_exchanged(spark, smoke_dir, name):
    plan = QUERIES[name](spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.split("\n") if "Join " in line or "Aggregate" in line)
    assert "i#" in last and "j#" in last and "place" in last


def test_links_within_clusters_of_many_blocks(spark, monkeypatch):
    from tessera.operators import graphs

    monkeypatch.setattr(graphs, "BLOCK_ROWS", 3)
    cluster, bridges, linked = {k: k % 2 for k in range(20)}, {4, 5, 11}, {4: [0, 2, 18, 2, 11], 5: [0, 19], 11: [4, 5]}
    clusters = spark.createDataFrame([(k, c, k in bridges) for k, c in cluster.items()] + [(3, 1, False)], "ref long, cluster_id long, is_bridge boolean")
    seeds = spark.createDataFrame(list(linked.items()), "bridge long, linked array<long>")
    want = {(t, b): 2 for b, found in linked.items() for t in found}
    for x, y in combinations(cluster, 2):
        if cluster[x] == cluster[y]:
            want.setdefault((y, x) if x in bridges and y not in bridges else (x, y), 1)
    got = [tuple(r) for r in graphs.directed_truth(clusters, seeds).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items())


def test_negatives_of_groups_are_not_exchanged(spark, smoke_dir):
    plan = QUERIES["p7_m9_negatives"](spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "__i#" in next(line for line in plan.split("\n") if "Join " in line or "Aggregate" in line)


def test_negatives_of_records_in_several_groups(spark):
    from tessera.operators.profiles import sampled_negatives

    group = {k: {k % 3} for k in range(12)} | {3: {0, 1}, 4: set(), 7: {2, 5}, 8: {5}}
    clusters = spark.createDataFrame([(k, k % 4 if k != 9 else None) for k in group], "ref long, cluster_id long")
    groups = spark.createDataFrame([(k, g) for k, found in group.items() for g in found or [None]], "ref long, group long")
    want = {(x, y) for x, y in combinations(group, 2) if 9 not in (x, y) and x % 4 != y % 4 and not group[x] & group[y]}
    assert sorted(tuple(r) for r in sampled_negatives(clusters, groups, 1000).collect()) == sorted(want)
    few = [tuple(r) for r in sampled_negatives(clusters, groups, 5).collect()]
    assert len(set(few)) == 5 and set(few) <= want


@pytest.mark.parametrize("name", ["f7_ambiguity", "f7_bound"])
def test_texts_are_compared_before_pairs_are_made(spark, smoke_dir, name):
    """Edit distances are of two groups with the same texts, below the step that pairs their members."""
    plan = QUERIES[name](spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    pairing = [k for k, line in enumerate(plan) if "Generate explode(__b" in line]
    assert pairing and pairing[-1] < min(k for k, line in enumerate(plan) if "levenshtein" in line)
