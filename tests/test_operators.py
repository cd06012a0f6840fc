"""Text functions, bridge synthesis, sources, sinks, streams and clusterings."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import candidates as K
from tessera.functions import sequence as Q
from tessera.functions import text as X
from tessera.operators import bridges as B
from tessera.operators import clustering, learning, records
from tessera.operators import series as V
from tessera.operators.records import Fields, ref
from tessera.sources import sinks, tables
from tessera.streaming import metadata


def values(spark, rows, **columns):
    df = spark.createDataFrame(rows, "a string, b string")
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


# ---- text ----


@pytest.mark.parametrize(
    ("a", "b", "ngram", "token", "weighted"),
    [("abcd", "abcd", 1, 1, 1), ("abcd", "bcde", 1 / 3, 0, None), ("ab", "ba", 1, 0, None), ("ABCD", "abcd", 1, 1, 1), ("new york", "York New", None, 1, None), ("a b", "b c", None, 1 / 3, None), ("", "", 0, 0, None), ("main street", "Main Street", 1, 1, 1), ("abc", "xyz", 0, 0, 0)],
)
def test_similarities(spark, a, b, ngram, token, weighted):
    ((n, t, w),) = values(spark, [(a, b)], n=X.ngram_similarity(F.col("a"), F.col("b")), t=X.token_similarity(F.col("a"), F.col("b")), w=Q.weighted_similarity(F.col("a"), F.col("b")))
    for got, want in ((n, ngram), (t, token), (w, weighted)):
        assert want is None or got == pytest.approx(want)
    side = Q.Against(b)
    assert side.exact(a.lower(), side.sets(a.lower())) == pytest.approx(w) and side.bound(a.lower(), side.sets(a.lower())) >= w - 1e-12


def test_sequence_similarity_knows_the_order(spark):
    assert values(spark, [("tide", "diet"), ("diet", "tide"), (None, "x")], s=Q.sequence_similarity("a", "b")) == [(0.25,), (0.5,), (None,)]


def test_record_similarity(spark):
    df = spark.createDataFrame([("main st", None, "Main St", "x")], "a string, b string, c string, d string")
    pairs = [(F.col("a"), F.col("c")), (F.col("b"), F.col("d"))]
    assert df.select(Q.record_similarity(pairs)).first()[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        Q.record_similarity([])


def test_small_texts(spark):
    rows = [("abcdef", "abXdefgh"), ("", "abc"), ("Same", "same")]
    got = values(spark, rows, p=X.common_prefix(F.col("a"), F.col("b")), m=X.blend(F.col("a"), F.col("b")), f=X.fallback_text(F.col("a"), F.col("b")))
    assert got == [("ab", K.zipped("abcdef", "abXdefgh"), "abcdef"), ("", "abc", ""), ("Same", K.zipped("Same", "same"), "Same")]
    assert [r[0] for r in values(spark, [("Größe der Straße, x_1 the", "")], t=X.tokens(F.col("a")))] == [["größe", "der", "straße", "x_1"]]
    assert values(spark, [("  a \t", "a")], s=X.edit_similarity(F.col("a"), F.col("b"))) == [(1.0,)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.uuid5(uuid.NAMESPACE_URL.bytes, F.lit("d\x1fk")).alias("u"), S.one_hot(F.lit(1), 3).alias("h"), S.alpha_tag(F.lit(0.65)).alias("t"), S.harmonic(0.5, F.lit(0.0), F.lit(1.0)).alias("z"), S.rounded(F.lit(2.675)).alias("r"), S.between(F.lit(None).cast("double"), 0, 1).alias("b")
    ).first()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "d\x1fk")) and row.h == [0.0, 1.0, 0.0] and row.t == "a065" and row.z == 0 and row.b is False
    assert sinks.directory_name("ds", 0.65, 2, True) == "amb_ds_a065_k2_dir"


# ---- bridges ----


@pytest.fixture(scope="module")
def two(spark):
    df = spark.createDataFrame([(1, "home", "John Doe", "1990", "X", 1), (2, "prox", "Jane Doe", "2000", "Y", 2)], "label long, source string, name string, year string, city string, cluster_id long")
    return df.select(ref(F.col("source"), "label").alias("ref"), "name", "year", "city", "cluster_id")


def seeds(spark, two):
    rows = spark.createDataFrame([(1, 2, 2.0, False, "1")], "home_cluster long, target_cluster long, score double, is_short boolean, label_key string")
    one = lambda k, name: two.filter(f"ref.label = {k}").select(F.col("ref").alias(name))
    found = rows.join(one(1, "home_ref")).join(one(2, "target_ref")).withColumn("linked", F.array("target_ref"))
    return records.integer_labels(found, two, ["home_cluster"])


@pytest.mark.parametrize("secondary", [(), ("year",)])
def test_bridge_of_two_records(spark, two, secondary):
    fields = Fields.of(two, targets=("name",), secondary=secondary)
    made = B.synthesize(seeds(spark, two), two, fields, [0.8, 0.5], ["term"])
    rows = {r.alpha: r for r in made.collect()}
    assert sorted(rows) == [0.5, 0.8] and all(r.bridge.label == 3 and r.bridge.source == "ambiguity-generator" for r in rows.values())
    assert all(r.fields.year == ("1990" if secondary else "") and r.fields.city == "" and r.fields.name not in ("John Doe", "Jane Doe") for r in rows.values())
    for alpha, r in rows.items():
        (want,) = K.bridged_values("John Doe", "Jane Doe", [alpha], ["term"])
        assert r.log[0].value == want["value"] == r.fields.name and r.log[0].sim_home == pytest.approx(want["sim_home"])
    variant = B.variant(made, two, fields, [0.5, 0.8])
    pairs = {(r.alpha, r.left.source, r.right.source): r.label for r in variant.directed.collect()}
    assert pairs == {(a, s, "ambiguity-generator"): n for a in (0.5, 0.8) for s, n in (("home", 1), ("prox", 2))}
    assert {r.label for r in variant.undirected.collect()} == {1}
    assert variant.records.filter("alpha = 0.5").count() == 3 and variant.link_log.count() == 2
    single = B.variant(B.synthesize(seeds(spark, two), two, fields, [0.5], ["term"]), two, fields, [0.5])
    assert sorted(single.at(0.5).records.collect()) == sorted(variant.at(0.5).records.collect())


def test_fields_and_labels(spark, two):
    assert Fields.of(two).names == ("city", "name", "year")
    with pytest.raises(ValueError):
        Fields.of(two, targets=("source",))
    assert records.label_kind(two) == "integer" and records.label_kind(spark.createDataFrame([], "ref struct<source:string,label:string>")) == "string"
    with pytest.raises(TypeError):
        records.label_kind(spark.createDataFrame([], "ref struct<source:string,label:double>"))
    counts = records.secondary_counts(seeds(spark, two), two.withColumn("year", F.when(F.col("ref.label") == 1, "").otherwise("1")), Fields.of(two, secondary=("year", "city"))).collect()
    assert sorted(tuple(r) for r in counts) == [("city", 1, 0, 0), ("year", 0, 1, 0)]


# ---- sources and sinks ----


def test_mapping_by_name_and_position(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,x,b\n1,s,2\n")
    df = tables.read(spark, str(tmp_path / "m.csv"))
    row = tables.mapping(df, {"left_id": 0, "left_source": "x", "right_id": "b"}, "left", "right").first()
    assert (row.left.source, row.left.label, row.right.source, row.right.label, row.label) == ("s", "1", "right", "2", 1)
    bare = tables.read(spark, str(tmp_path / "m.csv"), header=False)
    assert bare.count() == 2 and tables.row_count(spark, str(tmp_path / "m.csv")) == 1 and tables.row_count(spark, str(tmp_path / "none.csv")) is None


def test_comparison_space_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2)], "left int, right int")

    path = str(tmp_path / "space.parquet")
    assert tables.comparison_space(spark, path, build).count() == tables.comparison_space(spark, path, build).count() == 1 and len(calls) == 1
    pairs = spark.createDataFrame([(2, 1), (3, 4)], "left int, right int")
    assert [tuple(r) for r in tables.without_saved(pairs, spark, [path]).collect()] == [(3, 4)] and tables.without_saved(pairs, spark, None).count() == 2


def test_upsert_and_stream(spark, tmp_path):
    path = str(tmp_path / "meta.parquet")
    new = lambda rows, schema: spark.createDataFrame(rows, schema)
    sinks.upsert(spark, path, new([("a", 1), ("b", 2)], "dataset string, x int"))
    sinks.upsert(spark, path, new([("b", 3, "n"), ("c", 4, None)], "dataset string, x int, note string"))
    table = spark.read.parquet(path)
    assert table.columns == ["dataset", "x", "note"] and {r.dataset: r.x for r in table.collect()} == {"a": 1, "b": 3, "c": 4}
    source = str(tmp_path / "in")
    new([("b", 9, 1), ("b", 10, 2), ("d", 5, 1)], "dataset string, x int, version int").write.parquet(source)
    stream = spark.readStream.schema("dataset string, x int, version int").parquet(source)
    for _ in range(2):
        metadata.upsert_stream(stream, path, str(tmp_path / "ck")).awaitTermination()
    assert {r.dataset: r.x for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 10, "c": 4, "d": 5}


def test_windowed_stream(spark, smoke_dir, tmp_path):
    events = spark.read.parquet(f"{smoke_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = metadata.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_scalars_from_files(spark, tmp_path):
    for model, feature, rows in (("m", "f1", [(1, "loss", 3.0, 0), (1, "loss", 2.0, 1), (2, "loss", 1.0, 2)]), ("m", "f2", [(1, "loss", 9.0, 0)])):
        spark.createDataFrame([(model, *r) for r in rows], "model string, step long, tag string, value double, ordinal long").coalesce(1).write.parquet(str(tmp_path / "logs" / model / feature))
    got = V.last_values(tables.scalars(spark, str(tmp_path / "logs"), "m", "f1"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "loss", 2.0), (2, "loss", 1.0)]
    assert tables.scalars(spark, str(tmp_path / "nowhere")).count() == 0


def test_graph_files(spark, tmp_path, two):
    nodes, edges = two.select("ref"), two.alias("a").join(two.alias("b"), F.col("a.cluster_id") < F.col("b.cluster_id")).select(F.col("a.ref").alias("src"), F.col("b.ref").alias("dst"), F.lit(1).alias("label"), F.lit(0.5).alias("weight"))
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 1
    lines = [r.line for r in sinks.gml_lines(n, e).collect()]
    assert lines[0].startswith("graph [") and lines[-1] == "]" and any("edge [ source 1 target 2 label 1 weight 0.5 ]" in x for x in lines)


# ---- clusterings and learning ----


def two_groups():
    w = np.zeros((8, 8))
    for group in (range(4), range(4, 8)):
        for a in group:
            for b in group:
                if a != b:
                    w[a, b] = 0.9
    w[3, 4] = w[4, 3] = 0.1
    return w


@pytest.mark.parametrize("name", sorted(clustering.ALGORITHMS))
def test_algorithms_find_two_groups(name):
    assert sorted(map(sorted, clustering.ALGORITHMS[name](graph_of(two_groups())))) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def graph_of(w):
    i, j = np.nonzero(np.triu(w, 1))
    return clustering.Graph.of_edges(len(w), i, j, w[i, j])


def test_markov_equals_the_dense_walk(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(clustering, "CHUNK", 100)
    for _ in range(5):
        n = 30
        w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.12), 1)
        w += w.T
        flow = w + np.eye(n) * max(w.max(), 1.0)
        flow /= flow.sum(axis=0)
        for _ in range(100):
            new = (flow @ flow) ** 2
            new /= new.sum(axis=0)
            new[new < clustering.LEAST_FLOW] = 0
            new /= new.sum(axis=0)
            if np.abs(new - flow).max() < 1e-8:
                break
            flow = new
        owner = flow.argmax(axis=0)
        assert clustering.markov(graph_of(w)) == [np.flatnonzero(owner == k).tolist() for k in np.unique(owner)]


@pytest.mark.parametrize("name", sorted(clustering.ALGORITHMS))
def test_algorithms_on_many_nodes(name, monkeypatch):
    """A ring of cliques whose square would not be held: what is kept follows the edges."""
    import tracemalloc

    monkeypatch.setattr(clustering, "FEW_NODES", 100)  # as for more nodes, so that the test is quick
    n, size = (480 if name == "spectral" else 1600), 8
    inside = [(a, b, 0.9) for k in range(0, n, size) for a in range(k, k + size) for b in range(a + 1, k + size)]
    i, j, w = zip(*inside, *[(k + size - 1, (k + size) % n, 0.01) for k in range(0, n, size)], strict=True)
    tracemalloc.start()
    found = clustering.ALGORITHMS[name](clustering.Graph.of_edges(n, i, j, w))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x for part in found for x in part) == list(range(n)) and (peak < n * n * 8 / 2 or name == "spectral")
    if name in ("markov", "leiden"):
        assert all(len({x // size for x in part}) <= 2 for part in found) and len(found) >= n // size // 2


@pytest.mark.parametrize("name", ["wcc", *sorted(clustering.ALGORITHMS)])
def test_clusterings_cover_all_nodes(spark, name):
    w = two_groups()
    edges = spark.createDataFrame([(a, b, float(w[a, b])) for a in range(8) for b in range(8) if w[a, b] > 0], "src int, dst int, weight double")
    nodes = spark.createDataFrame([(k,) for k in range(10)], "ref int")
    got = {r.ref: r.cluster_id for r in clustering.cluster(nodes, edges, name).collect()}
    assert len(got) == 10 and got[8] != got[9] and len(set(got.values())) == (3 if name == "wcc" else 4) and got[0] == 1
    with pytest.raises(ValueError):
        clustering.cluster(nodes, edges, "other")


def test_folds_keep_groups_together(spark):
    rows = spark.createDataFrame([(k % 30, k % 30 < 12) for k in range(300)], "group int, positive boolean")
    folds = learning.fold_of(rows, 4, 1).collect()
    assert len(folds) == 30 and {r.fold for r in folds} == {0, 1, 2, 3}
    for kind in (True, False):
        sizes = np.bincount([r.fold for r in folds if (r.group < 12) == kind])
        assert sizes.max() - sizes.min() <= 1


def test_classifier_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, k % 40, float(rng.normal() + (k % 40 < 20)), float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, group int, x double, y double").withColumn("positive", F.col("group") < 20)
    near = learning.grouped_cv_auc(df, ["x", "y"], 4)
    monkeypatch.setattr(learning, "MOST_ROWS", 10)
    assert learning.grouped_cv_auc(df, ["x", "y"], 4) == pytest.approx(near, abs=1e-9) and near > 0.65


def test_boundary_falls_back_to_the_midpoint():
    same = learning.boundary_of((1.0, 1.0), (1.0, 1.0), 0.5)
    assert same.boundary_type == learning.MIDPOINT and same.boundary == 1.0
    assert learning.boundary_of((0.0, 4.0), (1.0, 1.0), 0.5).boundary == pytest.approx(2.0)
    assert not math.isnan(learning.boundary_of((0.0, 1.0), (1.0, 1.0), 0.001).boundary)


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from tessera import runtime

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master=master, setCheckpointDir=lambda _: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="shared folder"):
            runtime.shared_dir(unset(master))
    made = runtime.materialize(spark.range(100).withColumn("k", F.col("id") % 7), "some", buckets=(4, "k"))
    plan = made.join(made.groupBy("k").count(), "k")._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 100 and "Exchange hashpartitioning" not in plan.replace("BroadcastExchange", "")


def test_gml_round_trip(spark, tmp_path):
    kind = "struct<source:string,label:{}>"
    for label, names in (("long", [(f"s{k % 2}", k) for k in range(30)]), ("string", [("a b", 'x "q" & [y]'), ("a b", "z\\n"), ("ü", "7")])):
        nodes = spark.createDataFrame([(n,) for n in names], f"ref {kind.format(label)}").repartition(3)
        edges = spark.createDataFrame([(names[k], names[(k + 1) % len(names)], k % 3, k / 7) for k in range(len(names))], f"src {kind.format(label)}, dst {kind.format(label)}, label int, weight double")
        sinks.write_gml(nodes, edges, f"{tmp_path}/{label}.gml")
        back = tables.read_gml(spark, f"{tmp_path}/{label}.gml")
        assert [sorted(d.collect()) for d in back] == [sorted(d.collect()) for d in (nodes, edges)]
    (tmp_path / "other.gml").write_text('graph [\n  directed 1\n  node [\n    id 4\n    source "a"\n    ref "b]"\n  ]\n  node [\n    id 5\n    source "a"\n    ref "c"\n  ]\n  edge [\n    source 4\n    target 5\n    label 1\n    weight 0.5\n  ]\n]\n')
    nodes, edges = tables.read_gml(spark, f"{tmp_path}/other.gml")
    assert [tuple(r.ref) for r in nodes.orderBy("ref").collect()] == [("a", "b]"), ("a", "c")] and [(r.src.label, r.dst.label, r.label, r.weight) for r in edges.collect()] == [("b]", "c", 1, 0.5)]


def event_file(values):
    """Records of an event file: a version, then a scalar each."""
    import struct

    varint = lambda n: bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])
    sized = lambda field, data: varint(field << 3 | 2) + varint(len(data)) + data
    events = [struct.pack("<Bd", 9, 1.0) + sized(3, b"brain.Event:2")]
    for step, tag, value in values:
        scalar = sized(1, tag.encode()) + struct.pack("<Bf", 2 << 3 | 5, value)
        events.append(struct.pack("<Bd", 9, 2.0) + varint(2 << 3) + varint(step) + sized(5, sized(1, scalar)))
    return b"".join(struct.pack("<Q", len(e)) + bytes(4) + e + bytes(4) for e in events)


def test_event_files(spark, tmp_path):
    for folder, values in (("run_loss", [(0, "m", 1.0), (300, "m", 0.5), (300, "other", 9.0), (300, "m", 0.25)]), ("run_f1", [(1, "m", 0.75)])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "events.out.tfevents.1.host").write_bytes(event_file(values) + b"\x40\x00\x00\x00\x00\x00\x00\x00cut")
    got = [tuple(r) for r in tables.scalars(spark, str(tmp_path), "m", "loss").orderBy("ordinal").collect()]
    assert got == [(0, "m", 1.0, 1), (300, "m", 0.5, 2), (300, "m", 0.25, 3)]
    last = {(r.step, r.tag): r.value for r in V.last_values(tables.scalars(spark, str(tmp_path), "m", "loss")).collect()}
    assert last == {(0, "m"): 1.0, (300, "m"): 0.25}
    assert tables.scalars(spark, str(tmp_path)).count() == 5 and tables.scalars(spark, str(tmp_path), "none").count() == 0


def test_learned_matcher(spark, tmp_path):
    from tessera import config as C
    from tessera.operators import matching as M
    from tessera.plans import evaluation as E

    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(240):
        a = list(rng.choice(words, 6, replace=False))
        b = a if k % 3 == 1 else a + list(rng.choice(words, 6)) if k % 3 == 2 else list(rng.choice(words, 6))
        rows.append((k, (" ".join(a),), (" ".join(b),), k % 3))
    df = spark.createDataFrame(rows, "seq long, a struct<name:string>, b struct<name:string>, label int")
    M.fit_matcher(df, ["name"]).write().overwrite().save(f"{tmp_path}/models/people/best")
    matcher = E.matcher_of(C.build(C.MatcherConfig, {"name": "m", "type": "spark-ml", "path": f"{tmp_path}/models/{{dataset_name}}/best"}), ["name"], "people")
    got = matcher(df.drop("label")).collect()
    assert np.mean([r.label == r.seq % 3 for r in got]) > 0.95 and all(len(r.label_weights) == 3 and sum(r.label_weights) == pytest.approx(1) for r in got)
    two = M.model_matcher(M.fit_matcher(df.filter("label < 2"), ["name"]), ["name"])
    assert {len(r.label_weights) for r in two(df).collect()} == {3}
    with pytest.raises(C.ConfigError):
        E.matcher_of(C.build(C.MatcherConfig, {"name": "m", "type": "spark-ml"}), ["name"], "people")


def test_messages():
    from tessera.functions.messages import plural, stale_message

    assert (plural(1, "node"), plural(0, "node"), plural(2, "edge")) == ("1 node", "0 nodes", "2 edges")
    assert stale_message("x.gml", 1, 0, 3) == "x.gml belongs to other comparisons: 1 unexpected node, 0 missing nodes, 3 unexpected edges"


def test_chart_tables(spark):
    from tessera.operators import charts

    clusters = spark.createDataFrame([(k, 0 if k < 30 else k // 10) for k in range(80)], "ref long, cluster_id long")
    places = {r.ref: r for r in charts.cluster_places(clusters).collect()}
    centres = {r.cluster_id: r for r in charts.shelves(clusters).collect()}
    assert len(places) == 80 and centres[0].size == 30
    for r in places.values():
        c = centres[r.cluster_id]
        assert math.hypot(r.x - c.x, r.y - c.y) <= c.radius
    cs = list(centres.values())
    assert all(math.hypot(a.x - b.x, a.y - b.y) >= a.radius + b.radius - 1e-9 for k, a in enumerate(cs) for b in cs[:k])
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 6)], "src long, dst long")
    assert charts.graph_places(clusters, edges).select("cluster_id").distinct().count() == 80 - 3
    lines = charts.edge_lines(spark.createDataFrame([(0, 1, "TP"), (1, 2, "FN")], "left long, right long, status string"), charts.graph_places(clusters, edges)).collect()
    assert {(r.left, r.colour) for r in lines} == {(0, "green"), (1, "orange")} and all(r.x1 != r.x2 or r.y1 != r.y2 for r in lines)
    sweep = spark.createDataFrame([("d", 0.5, 1.0, None), ("d", 0.8, 2.0, 3)], "dataset string, alpha double, p double, q int")
    assert sorted(tuple(r) for r in charts.sweep_lines(sweep, "alpha", ["p", "q"]).collect()) == [("d", "p", 0.5, 1.0), ("d", "p", 0.8, 2.0), ("d", "q", 0.8, 3.0)]
