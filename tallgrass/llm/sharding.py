"""Operator 5: sharding by Karmarkar-Karp differencing.

Rows of equal text form a group that is never divided.  A partial partition is a vector of
k sums.  The two with the largest spread are combined, one in rising and one in falling
order, until one is left.

No task sees all groups.  Groups of at least a `unit` (the total over `UNITS_PER_SHARD`
units a shard) stand for themselves; there are at most total/unit of them.  The smaller
ones are first differenced, in batches, into bundles whose size is a unit, a quarter of
it, and so on down, so that coarse bundles carry the mass and fine ones close the gaps.
Bundles and large groups are then differenced over the shards.  Large groups are bounded by
the parameters; bundles are about LEVELS for each BATCH of small groups at least, so they grow
with the groups, at a rate of 1 to 3,000, and are differenced in the driver.

The law is `bytes`: sizes near equal.  A group larger than its share fills its shard alone.

Cases: null text has no bytes and falls in the group of the empty text, crc32 0; very long
texts are read whole; rows that repeat a doc_id, or have none, each take a slot; ties of spread
go by the order of keys; an empty table gives an
empty result; shards beyond the number of groups stay empty; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_or_empty

OVERHEAD = 16
UNITS_PER_SHARD = 16
LEVELS = 6
BATCH = 20_000
GROUPS_PER_TASK = 200_000
MOST_TASKS = 1_024
ROWS_PER_CHUNK = 50_000
LEAST_CHUNKS = 64
#: Bundles that may be told to all tasks by broadcast; 12 bytes each.
BROADCAST_BUNDLES = 1_000_000


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n vectors of k sums, each in rising order.

    Returns the final sums, and for each vector the place in them of each of its sums.
    """
    n, k = vectors.shape
    if not n:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    sums = {i: vectors[i] for i in range(n)}
    heap = [(-int(v[-1] - v[0]), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []  # first, second, order of the new sums
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        sums[n + len(made)] = both
        heapq.heappush(heap, (-int(both[-1] - both[0]), n + len(made)))
        made.append((a, b, order))
    places = np.empty((n, k), np.int64)
    at = {n + len(made) - 1: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        own = np.empty(k, np.int64)
        own[order] = at.pop(n + i)
        at[a], at[b] = own, own[::-1]
    for i in range(n):
        places[i] = at[i]
    return next(iter(sums.values())), places


def partition(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, from 0 to k - 1, of each of the given sizes."""
    vectors = np.zeros((len(sizes), k), np.int64)
    vectors[:, -1] = sizes
    return difference(vectors)[1][:, -1]


def _bundles(unit: int):
    """Bundle the small groups of a task: rows key, size -> key, bundle, size."""

    def run(frames):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for frame in _batches(frames):
            sizes = frame["size"].to_numpy()
            spread = np.array([int(key[:4], 16) for key in frame["key"]], np.int64)
            level = np.minimum(np.floor(-np.log2((spread + 1) / 65537)).astype(int), LEVELS - 1)
            name = np.empty(len(frame), np.int64)
            for j in range(LEVELS):
                (own,) = np.nonzero(level == j)
                if len(own):
                    parts = int(max(1, min(len(own), sizes[own].sum() * 4**j // unit)))
                    name[own] = made + partition(sizes[own], parts)
                    made += parts
            frame["bundle"] = (np.int64(task) << 32) + name
            yield frame[["key", "bundle", "size"]]

    return run


def _batches(frames):
    """Frames of BATCH rows: the fewer and larger, the fewer bundles."""
    held, rows = [], 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= BATCH:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def shards(docs: DataFrame, count: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of `docs`."""
    spark = docs.sparkSession
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
            F.sha2(text_or_empty(), 256).alias("key"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    n_rows = rows.count()
    total, n_groups = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    unit = max(1, total // (count * UNITS_PER_SHARD))
    tasks = min(MOST_TASKS, n_groups // GROUPS_PER_TASK + 1)
    small = groups.where(F.col("size") < unit).repartition(tasks, "key")
    bundled = cut(small.mapInPandas(_bundles(unit), "key string, bundle long, size long"))
    large = groups.where(F.col("size") >= unit).orderBy("key").select("key", "size").toPandas()  # at most total / unit
    bundles = bundled.groupBy("bundle").agg(F.sum("size").alias("size")).orderBy("bundle").toPandas()
    shard = partition(np.concatenate([large["size"], bundles["size"]]).astype(np.int64), count)
    large["shard"], bundles["shard"] = shard[: len(large)], shard[len(large) :]
    of_key = spark.createDataFrame(large[["key", "shard"]].astype({"shard": "int32"}), "key string, shard int")
    of_bundle = spark.createDataFrame(bundles[["bundle", "shard"]].astype({"shard": "int32"}), "bundle long, shard int")
    if len(bundles) <= BROADCAST_BUNDLES:
        of_bundle = F.broadcast(of_bundle)
    placed = cut(bundled.join(of_bundle, "bundle").select("key", "shard").unionByName(of_key))
    chunks = max(LEAST_CHUNKS, n_rows // (count * ROWS_PER_CHUNK) + 1)
    dealt = cut(rows.join(placed, "key").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")
    return (
        dealt.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
