"""The pipeline's stages, each against its own input."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join


def test_stages(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], small_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or seen[-1].columns == columns
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    for before, after in zip(seen[:2], seen[1:3], strict=True):
        assert after.join(before, "doc_id", "left_anti").count() == 0
        clean = before.join(labels, "doc_id", "left_semi").filter(F.regexp_count("text", F.lit(mixing.WORD)) >= 50)
        assert after.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    groups = {r.doc_id: r.component_id for r in ngram_join.link_components(seen[2]).collect()}
    assert sorted(r.doc_id for r in seen[3].select("doc_id").collect()) == sorted(set(groups.values()))
    taken = {r.doc_id: r.taken for r in mixing.Mix(mixing.sizes(seen[3])).taken().collect()}
    words = collections.Counter()
    for doc, text in seen[4].select("doc_id", "text").collect():
        words[doc] += len(text.encode().split())
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert seen[5].filter("piece = 0").count() == seen[4].count()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture
def odd(spark, tmp_path):
    """Null and empty texts, null ids and sources, ties, repeated rows, a very long text, and columns named like the stages' own."""
    long_text = "\n".join(prose(400, k) for k in range(60))
    texts = [(1, prose(300, 2)), (2, prose(300, 2)), (2, prose(300, 2)), (3, None), (4, ""), (5, " \t\n "), (None, prose(90, 3)), (None, prose(90, 3)), (7, long_text), (8, prose(70, 9)), (8, prose(80, 10))]
    rows = [(i, t, None, None if k % 2 else "b", None if t is None else len(t), "kept", 1.5, 7, "slots", 9, 10) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, size int, slots string, length long, id long"
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame(rows, schema), str(tmp_path)


def test_stages_on_odd_rows(spark, odd):
    """Each stage on its own takes them; those before the last return the columns of documents."""
    docs, at = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        got = out.collect()
        texts = {r.text for r in docs.collect()}
        assert name == "mixing sources" or {r.text for r in got} <= texts
        assert stage(spark, docs.limit(0), at).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    assert packed.filter("piece = 0").count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), at).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, at).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "7", "8", "8", "None", "None"]


def test_pipeline_of_empty_and_odd_tables(spark, odd):
    docs, at = odd
    docs.write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).filter("length > 2048").count() == 0
    docs.limit(0).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
