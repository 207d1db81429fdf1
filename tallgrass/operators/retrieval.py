"""Choosing tools for a conversation.

A request is a row; messages have request, turn, role and content; tools have id, name, ord
and a vector v.  Whatever needs a model is a function that the caller passes: an embedder,
a chooser, a reranker.  `select` dispatches on the mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import nearest

TOP, CANDIDATES = 5, 10
LAST_CHARS, CONTEXT_CHARS = 500, 2_000
INSTRUCTION = "Given a conversation, retrieve the tools that help with it"


def last_user_query(messages: DataFrame, most: int = LAST_CHARS) -> DataFrame:
    """request, query: the start of the last user message, else empty."""
    own = F.when(F.col("role") == "user", F.struct("turn", "content"))
    found = messages.groupBy("request").agg(F.max(F.when(F.col("content").isNotNull(), own)).alias("x"))
    return found.select("request", F.coalesce(F.substring("x.content", 1, most), F.lit("")).alias("query"))


def context_query(messages: DataFrame, most: int = CONTEXT_CHARS, keep: str = "head") -> DataFrame:
    """request, query: all messages as `[ROLE]: content` lines, cut to their first (or last) characters."""
    told = messages.where(F.trim("content") != "")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content"))
    rows = told.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda m: m["line"]), "\n")
    cut = F.substring(joined, 1, most) if keep == "head" else F.right(joined, F.lit(most))
    found = messages.select("request").distinct().join(rows, "request", "left")
    return found.select("request", F.coalesce(cut, F.lit("")).alias("query"))


def instructed(queries: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """Queries behind an instruction, as some embedders want them; cutting came before."""
    return queries.withColumn("query", F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), F.col("query")))


def embedding_text(name: Column, description: Column, separator: str = ": ") -> Column:
    return F.concat(name, F.lit(separator), description)


def with_vectors(rows: DataFrame, text: str, cache: DataFrame, size: int, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """`rows` with v: from the cache (text, v), else from the embedder, else zeros."""
    known = cache.select(F.col("text").alias(text), F.col("v"))
    found = rows.join(known, text, "left")
    missing = embed(F.col(text)) if embed else F.lit(None).cast("array<double>")
    return found.withColumn("v", F.coalesce("v", missing, F.array_repeat(F.lit(0.0), size)))


def by_embedding(queries: DataFrame, tools: DataFrame, k: int = TOP) -> DataFrame:
    """request, name, similarity, rank: the nearest tools of different names (the first of equals)."""
    from .relational import first_by

    one = first_by(tools.select("name", "ord", "v"), ["name"], ["ord"])
    found = nearest(queries.select(F.col("request").alias("id"), "v"), one.select(F.col("ord").alias("id"), "v"), k, same=False)
    names = one.select(F.col("ord").alias("item"), "name")
    return found.join(names, "item").select(F.col("query").alias("request"), "name", "similarity", "rank")


def parsed_order(reply: Column) -> Column:
    """array<int> of a reranker's reply: JSON, else the first bracketed list of numbers, else null."""
    whole = F.from_json(F.trim(reply), "array<int>")
    inner = F.from_json(F.regexp_extract(reply, r"(\[[\d,\s]*\])", 1), "array<int>")
    return F.coalesce(whole, F.when(F.size(inner) >= 0, inner))


def reranked(candidates: DataFrame, orders: DataFrame, k: int = TOP) -> DataFrame:
    """request, name, rank: candidates in the order of a reply (request, reply).

    Numbers are places from 0; those out of range and repeats are dropped, and what is not
    named is left out.  Up to k candidates are returned as they are, and so are the first k
    where the reply can't be read.
    """
    sizes = candidates.groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    told = sizes.join(orders, "request", "left").select("request", "n", parsed_order(F.col("reply")).alias("order"))
    plain = (F.col("n") <= k) | F.col("order").isNull()
    use = F.when(plain, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(
        F.array_distinct(F.filter("order", lambda i: (i >= 0) & (i < F.col("n"))))
    )
    places = told.select("request", F.posexplode(F.slice(use, 1, k)).alias("at", "place"))
    named = candidates.withColumn("place", F.col("rank").cast("int") - 1)
    return places.join(named, ["request", "place"]).select("request", "name", (F.col("at") + 1).alias("rank"))


def chosen(tools: DataFrame, choices: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """request, name, rank: the tools that a chooser named (request, names), in catalog order."""
    named = choices.select("request", F.explode("names").alias("name")).distinct()
    w = Window.partitionBy("request").orderBy("ord")
    found = named.join(tools.select("name", "ord"), "name").withColumn("rank", F.row_number().over(w))
    return found.where(F.col("rank") <= most).select("request", "name", "rank")


@dataclass
class Models:
    """Functions in place of models.

    embed: queries (request, query) -> (request, v).  choose: queries -> (request, names).
    rerank: candidates (request, name, rank) and queries -> (request, reply).
    """

    embed: Callable[[DataFrame], DataFrame] | None = None
    choose: Callable[[DataFrame], DataFrame] | None = None
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None


MODES = (
    "in_context",
    "hierarchical",
    *(f"{model}embedding{context}{rerank}" for model in ("", "qwen3_") for context in ("", "_context") for rerank in ("", "_reranker")),
)


def select(mode: str | None, messages: DataFrame, tools: DataFrame, models: Models, k: int = TOP) -> DataFrame:
    """request, name, rank under one of MODES; in_context, the default, gives all tools."""
    mode = (mode or "in_context").lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "in_context":
        w = Window.partitionBy("request").orderBy("ord")
        every = messages.select("request").distinct().join(tools.select("name", "ord"), F.lit(True))
        return every.select("request", "name", F.row_number().over(w).alias("rank"))
    queries = context_query(messages) if "context" in mode else last_user_query(messages)
    if mode == "hierarchical":
        return chosen(tools, models.choose(queries))
    asked = instructed(queries) if mode.startswith("qwen3") else queries
    found = by_embedding(models.embed(asked), tools, CANDIDATES if mode.endswith("reranker") else k)
    if mode.endswith("reranker"):
        return reranked(found, models.rerank(found, queries), k)
    return found.select("request", "name", "rank")
