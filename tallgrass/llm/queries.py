"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, html_text, language_id, near_dedup, pii, sharding, spelling, suffix_dedup, token_alignment, token_rollup, url_filter
from .common import cut, shared_dir, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of `documents`."""
    small_batches(spark)
    trips = bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )
    return bpe.digests(trips)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates over all rows of `documents`."""
    small_batches(spark)
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


#: The rules of the contract, as verdict, host and start of the path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of `pages` by the rules, else by its host's place in the link graph."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all rows of `documents`."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 40 shards of near equal bytes."""
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`."""
    small_batches(spark)
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text of `documents` without repeated strings of 200 bytes."""
    small_batches(spark)
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"), suffix_dedup.LENGTH)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each of `documents` holds; documents without one have no row."""
    small_batches(spark)
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    small_batches(spark)
    return html_text.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all `documents` under two tokenizer versions after three batches of changes.

    Inserts of every document; revised counts for texts with runs of white space, which
    are collapsed; deletions of texts without a letter.  The second batch is sent twice.
    """
    small_batches(spark)
    text, vocabulary = F.coalesce("text", F.lit("")), public_tokenizers.path(VOCABULARY)
    # single blanks, which are most runs of white space, are no matches
    collapsed = F.regexp_replace(text, r"\s{2,}|[\t-\r]", " ")
    read = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        bpe.count_variants(F.col("text"), collapsed, vocabulary, public_tokenizers.PATTERN).alias("counted"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("words"),
        (~text.rlike(r"\p{L}")).alias("gone"),
    )
    bpe_counts = [F.col("counted.own").alias("bpe"), F.col("counted.variant").alias("bpe_revised")]
    counts = cut(read.select("doc_id", "source", "lang", *bpe_counts, "words", "gone"))

    def rows(bpe_tokens, where=None):
        found = counts.where(where) if where is not None else counts
        versions = F.array(
            F.struct(F.lit("byte_bpe_50k").alias("version"), bpe_tokens.alias("tokens")),
            F.struct(F.lit("words").alias("version"), F.col("words").alias("tokens")),
        )
        return found.select("doc_id", "source", "lang", F.inline(versions))

    store = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("1-load", token_rollup.changes("insert", rows(F.col("bpe"))))
    revised = token_rollup.changes("revise", rows(F.col("bpe_revised"), F.col("bpe_revised").isNotNull()))
    store.commit("2-collapse", revised)
    store.commit("2-collapse", revised)
    store.commit("3-no-letter", token_rollup.changes("delete", rows(F.col("bpe"), F.col("gone"))))
    return store.totals()


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    small_batches(spark)
    field = pii.fit(pii.labelled(spark))
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents"), field))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all `documents` with their near words, forms and roots."""
    small_batches(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of `documents` under two vocabularies, aligned, with the counts of linked ids."""
    small_batches(spark)
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    told = aligned.select("doc_id", "n_a", "n_b", "n_groups", "a", "b", "links", digest)
    found = token_alignment.scored(told).withColumnRenamed("n_best_b", "n_best")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_near_dedup": op2_near_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_html_text": op9_html_text,
        "op10_token_rollup": op10_token_rollup,
        "op11_pii": op11_pii,
        "op12_spelling": op12_spelling,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    }
