"""What stages ask of the driver: few jobs, however many partitions an exchange has."""

from uuid import uuid4

import numpy as np
import pytest

from tessera.llm import ngram_join


@pytest.fixture
def wide(spark):
    """Many partitions that are not merged."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def load(spark, run):
    """(jobs, tasks, result) of a call."""
    sc, name = spark.sparkContext, uuid4().hex
    sc.setJobGroup(name, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(name)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return len(jobs), sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)), out


def near_copies(n, chains=()):
    """(doc_id, text): n copies of a text, each with a last word of its own, and chains of texts whose neighbours link."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(n)]
    for c, length in enumerate(chains):
        rows += [(1000 * (c + 1) + k, " ".join([*base[: 50 - 20 * (c > 0)], *[f"c{c}x{j}" for j in range(3 * k, 3 * k + 30)]])) for k in range(length)]
    return rows


def test_sketch_takes_few_jobs(wide):
    docs = wide.createDataFrame(near_copies(50), "doc_id long, text string")
    jobs, _, sketch = load(wide, lambda: ngram_join.frequency_sketch(docs, 2850))
    assert jobs <= 5
    wide.conf.set("spark.sql.shuffle.partitions", "2")
    assert np.array_equal(sketch, ngram_join.frequency_sketch(docs, 2850)) and sketch.max() == 5


@pytest.mark.parametrize("chains", [(), (12, 9)])
def test_rest_of_large_parts_is_found_once(wide, monkeypatch, chains):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rows = near_copies(40, chains)
    docs = wide.createDataFrame(rows, "doc_id long, text string")
    _, tasks, got = load(wide, lambda: {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()})
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in rows:
        for i, a in sets.items():
            want[i] = min(want[j] for j, b in sets.items() if 100 * len(a & b) >= 80 * len(a | b))
    assert got == want
    assert chains or tasks < 1320
