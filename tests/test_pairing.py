"""Scores, rankings, blocking and greedy pairing on small datasets with known results."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairing as P
from tessera.operators import scoring as C
from tessera.operators import components
from tessera.operators.components import connected_components
from tessera.operators.records import Fields, ref


def dataset(spark, rows, fields, targets, **options):
    """rows: (label, fields..., cluster)."""
    schema = "label long, " + ", ".join(f"{f} string" for f in fields) + ", cluster_id long"
    df = spark.createDataFrame(rows, schema).select(ref("ds", "label").alias("ref"), *fields, "cluster_id")
    return df, Fields.of(df, fields, targets=targets, **options)


@pytest.fixture(scope="module")
def links(spark):
    return dataset(spark, [(1, "abc", 1), (2, "abc", 2), (3, "xyz", 2)], ("name",), ("name",))


@pytest.mark.parametrize(("n", "score"), [(1, 2.0), (2, 0.0)])
def test_best_scores_by_links(links, n, score):
    (seed,) = P.greedy_seeds(*links, links=n).collect()
    assert seed.score == score and seed.home_ref.label == 1 and [r.label for r in seed.linked] == [2, 3][:n]


def test_short_bridges_and_thresholds(links):
    assert tuple(P.summary(P.greedy_seeds(*links, links=2)).first()) == (1, 2, 0)
    assert tuple(P.summary(P.greedy_seeds(*links, links=3)).first()) == (1, 2, 1)
    assert tuple(P.summary(P.greedy_seeds(*links, min_score=2.5, links=2)).first()) == (0, 0, 0)


@pytest.fixture(scope="module")
def blocking(spark):
    rows = [(1, "alpha beta", "", 1), (2, "gamma", "zeta", 1), (3, "alpha beta", "", 2), (4, "beta delta", "", 2), (5, "alpha", "zeta", 3)]
    return dataset(spark, rows, ("name", "city"), ("name",))


@pytest.mark.parametrize(("options", "edges"), [({}, [(1, 3), (1, 4), (1, 5)]), ({"scope": "mutual"}, [(1, 3)]), ({"max_block_size": 2}, [])])
def test_blocking(blocking, options, edges):
    assert sorted((r.home.label, r.target.label) for r in P.token_blocking(*blocking, **options).collect()) == edges


def test_unknown_scope_and_strategy(blocking):
    with pytest.raises(ValueError):
        P.token_blocking(*blocking, scope="some")
    with pytest.raises(ValueError):
        P.seeds(*blocking, strategy="other")


def test_score_rules(spark):
    rows = [("Main St", "main st ", 2.0), ("abc", "abd", 2 * (1 - 1 / 3)), ("", "abc", 2.0), (None, None, 2.0), (None, "abc", -1.0), ("same", "same", 2.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    score = C.field_score(F.col("a"), F.col("b"), text=True, target=True, null_is_absent=False)
    assert all(r.got == pytest.approx(r.want) for r in df.withColumn("got", score).collect())
    plain = C.field_score(F.col("a"), F.col("b"), text=True, target=False, null_is_absent=True)
    assert [r.got for r in df.withColumn("got", plain).collect()] == [-0.5, -0.5, -0.5, 0.0, -0.5, 2.0]
    bound = C.field_score(F.col("a"), F.col("b"), text=True, target=True, null_is_absent=False, bound=True)
    assert df.withColumn("s", score).withColumn("u", bound).filter("u < s").count() == 0


def literal_greedy(n, score, threshold):
    homes, out = set(), []
    for h in range(1, n + 1):
        options = [(j, score.get((h, j))) for j in range(1, n + 1) if j != h and j not in homes]
        options = [(j, s) for j, s in options if s is not None]
        if options and (best := max(options, key=lambda x: x[1])) and (threshold is None or best[1] >= threshold):
            homes.add(h)
            out.append((h, *best))
    return out


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_greedy_against_the_rule(spark, few, monkeypatch):
    monkeypatch.setattr(P, "FEW_EDGES", few)
    rng = random.Random(5)
    for _ in range(3):
        n = 9
        score = {}
        for h in range(1, n + 1):
            for j in range(h + 1, n + 1):
                score[h, j] = score[j, h] = rng.choice([0.5, 1.0, 1.5, 2.0, 2.5])
        edges = spark.createDataFrame([(h, j, s) for (h, j), s in score.items()], "home long, target long, score double")
        assert sorted(tuple(r) for r in P.greedy_all(edges).collect()) == literal_greedy(n, score, None)
        found = [tuple(r) for r in P.greedy_from(edges, [1.0, 2.0, 2.5]).collect()]
        for t in (1.0, 2.0, 2.5):
            assert sorted(r[1:] for r in found if r[0] == t) == literal_greedy(n, score, t)


def test_representative_with_no_positive_mean(spark):
    rows = [(1, "aaa", "q", 1), (2, "bbb", "r", 1), (3, "ccc", "s", 1)]
    df, fields = dataset(spark, rows, ("name", "city"), ())
    assert [(r.ref.label, r.rank) for r in C.rank_members(df, fields).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_against_union_find(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(3)
    for n, m in ((60, 40), (200, 400), (300, 150)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1040)]
        label = {x: x for p in pairs for x in p}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {x: c for x, c in label.items() if x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    texts = connected_components(spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y"), ("z", None)], "src string, dst string"))
    assert {r.node: r.component for r in texts.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_pairs_of_members_in_blocks(spark, monkeypatch):
    """A group larger than a block gives the same pairs."""
    from tessera.operators import members

    rows = spark.createDataFrame([(k, 0 if k < 40 else k % 5 + 1) for k in range(70)], "ref long, cluster_id long")
    pairs = lambda: sorted(tuple(r) for r in members.member_pairs(rows, "cluster_id", "ref", {"a": "ref"}, {"b": F.col("ref") + 0}).collect())
    whole = pairs()
    assert len(whole) == 40 * 40 + 5 * 36
    monkeypatch.setattr(members, "BLOCK_ROWS", 7)
    assert pairs() == whole


@pytest.mark.parametrize("absent", [False, True])
def test_mean_ambiguity_against_pairs(spark, absent):
    """Sums over values equal sums over pairs, with nulls, repeats, texts and numbers."""
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "", "ab c", "ab", "AB c ", "xyz"]), rng.choice([None, "p", "q"]), rng.choice([None, 1, 2]), k % 4 if k < 38 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "label long, name string, kind string, n int, cluster_id long").select(ref(F.lit("s"), "label").alias("ref"), "name", "kind", "n", "cluster_id")
    fields = Fields.of(df, targets=("name",), null_is_absent=absent)
    pairs = C.score_pairs(C.cluster_pairs(df), df, fields)
    both = pairs.select(F.col("left").alias("ref"), "score").unionByName(pairs.select(F.col("right").alias("ref"), "score"))
    want = {r.ref.label: r.mean for r in both.groupBy("ref").agg(F.avg("score").alias("mean")).collect()}
    got = {r.ref.label: r.mean for r in C.mean_ambiguity(df, fields).collect()}
    assert len(got) == 38 and got == pytest.approx(want)
    assert {r.ref.label: (r.rank, r.mean) for r in C.rank_members(df, fields).collect() if r.cluster_id >= 38} == {38: (0, 0.0), 39: (0, 0.0)}


@pytest.mark.parametrize("absent", [False, True])
@pytest.mark.parametrize("targets", [("name",), ("name", "kind"), ()])
def test_scored_pairs_against_pairs(spark, absent, targets, monkeypatch):
    """Groups of the same texts, cut into blocks and pieces, give every pair of different refs once, with its score."""
    from tessera.operators import members

    rng = random.Random(8)
    rows = [(k, rng.choice([None, "", "ab c", "ab", "AB c ", "xyz"]), rng.choice([None, "p", "pq"]), rng.choice([None, 1, 2]), k % 3 if k < 38 else k) for k in range(40)]
    df = spark.createDataFrame([*rows, rows[0], (1, "xyz", None, 2, 1)], "label long, name string, kind string, n int, cluster_id long").select(ref(F.lit("s"), "label").alias("ref"), "name", "kind", "n", "cluster_id")
    fields = Fields.of(df, ("n", "name", "kind"), targets=targets, null_is_absent=absent)
    carried = C.cluster_pairs(df.withColumn("values", C.record(fields)), ["values"])
    exact, bound = (C.ambiguity("left_values", "right_values", fields, bound=b, normals=True) for b in (False, True))
    want = sorted(tuple(r) for r in carried.select("left.label", F.col("right.label").alias("r"), exact.alias("s"), bound.alias("b")).collect())
    for block, piece in ((2048, 32), (2048, 2), (5, 2), (3, 32)):
        monkeypatch.setattr(members, "BLOCK_ROWS", block)
        monkeypatch.setattr(members, "PIECE_ROWS", piece)
        found = C.scored_pairs(df, fields, {"score": False, "bound": True})
        assert sorted(tuple(r) for r in found.select("left.label", F.col("right.label").alias("r"), "score", "bound").collect()) == want


def test_roles_of_pairs_are_counted(spark):
    """Pairs with a bridge one by one, others by the values of their ends, as many as there are of each role and score."""
    from tessera.operators import profiles as R

    rng = random.Random(9)
    rows = [(k, rng.choice([None, "ab c", "ab", "xyz"]), rng.choice([None, 1, 2]), k % 3, rng.choice([True, False, False, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "ref long, name string, n int, cluster_id long, bridge boolean").withColumnRenamed("n", "size")
    fields = Fields.of(df, ("name", "size"), targets=("name",))
    marked = df.fillna(False, ["bridge"]).withColumn("values", C.record(fields))
    truth = C.cluster_pairs(marked, ["bridge", "values"]).withColumn("label", F.when(F.col("right_bridge"), 2).otherwise(1))
    want = C.score_carried(R.pair_roles(truth, ["values"]), fields)
    tables = R.one_way_roles(df, fields)
    got = [(r.right, r.role, r.score, r.n) for t in tables for r in t.collect()]
    flat = sorted((role, score, right if role != "extra" else 0) for right, role, score, n in got for _ in range(n))
    assert flat == sorted((r.role, r.score, r.right if r.role != "extra" else 0) for r in want.collect())
    extra = [n for _, role, _, n in got if role == "extra"]
    assert 2 * len(extra) < sum(extra)
    assert R.direction_metrics(tables).first() == R.direction_metrics(want).first()
