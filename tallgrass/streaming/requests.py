"""Retrieval requests as a stream: each micro-batch of requests is answered with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallgrass.operators.retrieval import MODES, Models, select

#: A request: an id, a mode (null: the default) and its messages.
REQUEST = "request string, mode string, messages array<struct<role:string,content:string>>"


def answer(requests: DataFrame, tools: DataFrame, models: Models, default: str = "in_context") -> DataFrame:
    """request, mode, name, rank, error for a batch of requests, each under its own mode."""
    rows = requests.withColumn("mode", F.lower(F.coalesce("mode", F.lit(default))))
    messages = rows.select("request", "mode", F.posexplode_outer("messages").alias("turn", "m")).select(
        "request", "mode", F.coalesce("turn", F.lit(0)).alias("turn"), "m.role", "m.content"
    )
    unknown = rows.where(~F.col("mode").isin(*MODES)).select(
        "request", "mode", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("rank"), F.lit("unknown mode").alias("error")
    )
    out = unknown
    for mode in [r["mode"] for r in rows.select("mode").distinct().collect() if r["mode"] in MODES]:
        found = select(mode, messages.where(F.col("mode") == mode).drop("mode"), tools, models)
        out = out.unionByName(found.select("request", F.lit(mode).alias("mode"), "name", F.col("rank").cast("int").alias("rank"), F.lit(None).cast("string").alias("error")))
    return out


def serve(stream: DataFrame, tools: DataFrame, models: Models, out: str, checkpoint: str, default: str = "in_context") -> StreamingQuery:
    """Answer a stream of requests (schema REQUEST) into Parquet.

    A batch is written to a folder named by its number, in place of an earlier attempt, so
    each request is answered once.
    """

    def batch(requests: DataFrame, number: int) -> None:
        answer(requests, tools, models, default).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
