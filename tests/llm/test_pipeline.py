"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import frame
from .test_copies import brute_lines, links_of, roots_of, word_set
from .test_texts import brute


@pytest.fixture(scope="module")
def steps(spark, tiny, tmp_path_factory):
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("step") / name)
        stage(spark, docs, tiny).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay_those_of_documents(steps):
    for name, (before, after) in steps.items():
        if name != "pack":
            assert after.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count() == 0


def test_languages_are_kept(steps):
    before, after = steps["language"]
    assert set(rows(after)) <= set(rows(before)) and after.count() >= 0.99 * before.count()


def test_lines(steps):
    before, after = map(rows, steps["line_dedup"])
    kept = {(i, k) for i, k, j, m in brute_lines(before) if (i, k) == (j, m)}
    want = []
    for i, t in before:
        left = [x for k, x in enumerate(t.split("\n")) if (str(i), k) in kept or not x.strip()]
        if any(x.strip() for x in left):
            want.append((i, "\n".join(left)))
    assert after == want


def test_near_copies(steps):
    before, after = map(rows, steps["near_dedup"])
    top = roots_of(len(before), links_of([word_set(t) for _, t in before], 80))
    assert after == [r for k, r in enumerate(before) if top[k] == k]


def test_benchmark_passages(steps, spark, tiny):
    before, after = map(rows, steps["decontaminate"])
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute(before, items) if r[-1]}
    assert after == [r for r in before if str(r[0]) not in bad]


def test_all_that_is_left_is_packed(steps, spark, tiny):
    before, after = steps["pack"]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in rows(before)}
    total = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert total.where("n <> m").count() == 0


def test_stages_on_no_and_odd_rows(spark, tiny, empty, odd):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    none, docs = empty.select(names), odd.select(names)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tiny).count() == 0, name
        got = stage(spark, docs, tiny)
        assert got.count() <= docs.count() + 200
        assert name == "pack" or got.columns == names


def test_a_group_of_copies_leaves_one(spark, tiny):
    text = " ".join(f"word{k}" for k in range(60))
    made = frame(spark, [(k, text + f" end{k}") for k in range(5)]).select("doc_id", "text", "lang", "source", "n_chars")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, made, tiny).collect()] == [0]
