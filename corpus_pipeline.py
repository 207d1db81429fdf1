"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
A doc_id that comes with several texts stays as long as any of its rows does.

Cases, in every stage: an empty table gives an empty one with the same columns.  A null or empty text has no
language to be told, so the first stage drops it.  Rows of null doc_id are one document: they stay or go together.
Very long texts are read whole.  Of equal or near texts the least doc_id stays, so there are no ties; rows that repeat
both doc_id and text stay together.  Further columns are carried through the stages up to the last and read by none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from tallgrass.llm.common import cut, not_kept, small_batches, table, without

VOCABULARY = "byte_bpe_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is fitted on a bounded sample of them."""
    small_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return docs.where(~language_id.predict(F.col("text"), model, spark)["rejected"])


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text the one of least doc_id."""
    return without(docs, not_kept(exact_dedup.exact_groups(docs)))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least doc_id."""
    small_batches(spark)
    return without(docs, not_kept(near_dedup.near_groups(docs)))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, and whether the ids decode to the text's bytes."""
    small_batches(spark)
    vocabulary, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = docs.select("doc_id", "source", "lang", "text", bpe.encode(F.col("text"), vocabulary, pattern).alias("ids"))
    decoded = bpe.decode(F.col("ids"), vocabulary, pattern)
    same = decoded == F.coalesce("text", F.lit("")).cast("binary")
    return ids.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", clean_of_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: Order MinHash, centroids and merges by rank are not to be said in SQL.
ORACLE_SQL = None
