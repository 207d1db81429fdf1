"""Connected components of a table of links, by alternating large and small stars.

No neighbour list is ever gathered: each step is a minimum by node, aggregated on both
sides of the exchange, and a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_and_count, cut_and_tell, drop

#: Links that a task takes at most where there are fewer than would fill the session's partitions.
TASK_LINKS = 20_000
LEAST_TASKS = 8


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """node, root: for each node of links (a, b), the least node that it is linked to, at any remove.

    Nodes are of any ordered type.  Links may repeat, in either direction, or be loops.  `tasks` write the links, if it
    is known how many do.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, n_edges = cut_and_count(edges.coalesce(tasks) if tasks else edges)
    # rounds over few links are many small stages: a task each for TASK_LINKS of them, as edges never grow in number
    tasks = max(LEAST_TASKS, n_edges // TASK_LINKS + 1)

    def cut_in(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(tasks))

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_in(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u")
        after, state = cut_and_tell(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .coalesce(tasks),
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        )
        drop(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state

