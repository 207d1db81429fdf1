"""The corpus pipeline against a plain version of its stages."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from tallgrass.llm import bpe


def test_stages(spark, tmp_path):
    base = [f"the word number {i} of a long text about cats and dogs that sat there" for i in range(40)]
    story = " ".join(base[:12])
    rows = [
        (1, story), (2, story.replace(" ", "\n")), (3, story.replace("number 5", "figure 5")), (4, "123 456"), (5, None),
        (6, "Some other tale which holds that the quick brown fox jumps over a lazy dog again and again until it sleeps"),
        (7, " ".join(base[20:30])), (8, ""), (7, " ".join(base[20:30])),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog again and again")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 7]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={}
    )
    texts = dict(rows)
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i, library.encode_ordinary(texts[i])) for i in (1, 7, 7))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
