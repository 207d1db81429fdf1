"""The pipeline's stages on empty tables, nulls, repeated rows, very long texts and further columns."""

import random

import pytest

import corpus_pipeline

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_key string, score double"


@pytest.fixture()
def folder(spark, tmp_path):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog again and again")], "item_id long, text string")
    items.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, "clash", 0.5) for i, t in rows], SHAPE)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, folder, stage):
    docs = docs_of(spark, [])
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert out.count() == 0 and (stage == "bpe" or out.columns == docs.columns)


def test_stages_of_odd_rows(spark, folder):
    rnd = random.Random(3)
    words = "the of and to in that it was for on with as his her they at be this from have or by one had not but what all were when".split()
    story = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, other, third = story(60_000), story(80), story(70)
    rows = [(1, long), (2, long + " end"), (3, other), (3, other), (4, other), (None, third), (5, None), (6, ""), (7, "the quick brown fox jumps over a lazy dog again and again")]
    docs = docs_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    got = sorted((r["doc_id"], r["n_chars"]) if r["doc_id"] is not None else (0, r["n_chars"]) for r in docs.collect())
    assert got == [(0, len(third)), (1, len(long)), (3, len(other)), (3, len(other))]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert all(r["round_trip"] and r["n_tokens"] > 0 for r in last) and len(last) == 4
