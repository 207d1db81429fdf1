"""Dedupe, set, join and ordering operators over tables with an explicit order column.

Nothing here depends on the order of rows in a partition: `order` columns say which row is
first, and ties must be broken by adding columns to them.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def settled(df: DataFrame) -> DataFrame:
    """`df` on reliable storage, so that a lost executor can't make it come out in another way.

    The folder is the session's spark.checkpoint.dir; one is made only where none is set and all
    runs on one machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if found is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tallgrass-"))
    return df.checkpoint()


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key.  An aggregate with partial sums, so hot keys don't matter."""
    best = df.groupBy(*key).agg(F.min_by(_row(df), F.struct(*order)).alias("row"))
    return best.select("row.*")


def last_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    best = df.groupBy(*key).agg(F.max_by(_row(df), F.struct(*order)).alias("row"))
    return best.select("row.*")


def last_definition(df: DataFrame, key: str, order: str) -> DataFrame:
    """As a dict that is filled in order: the last row of each key at the key's first place; null keys go."""
    rows = df.where(F.col(key).isNotNull())
    found = rows.groupBy(key).agg(F.max_by(_row(df), order).alias("row"), F.min(order).alias("first"))
    return found.select(*[F.col(f"row.{c}").alias(c) for c in df.columns if c != order], F.col("first").alias(order))


def union_tagged(parts: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    """Union of tables with a column that names each one's part."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def without_keys(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the other table."""
    return df.join(other.select(*key), list(key), "left_anti")


def with_keys(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(other.select(*key), list(key), "left_semi")


def numbered(df: DataFrame, order: Sequence[str], name: str = "nth") -> DataFrame:
    """Gapless numbers from 0 in the given order, without gathering all rows in one task.

    Rows are dealt into ranges of the order; the numbers of earlier ranges are added up from
    the counts per range.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        ranged.join(offsets, "__part")
        .withColumn(name, F.col("__from") + F.row_number().over(inside) - 1)
        .drop("__part", "__from")
    )


def chunks(df: DataFrame, order: Sequence[str], size: int, value: Column) -> DataFrame:
    """chunk, items: every `size` consecutive rows as one array; the last may be shorter."""
    rows = numbered(df, order).withColumn("__value", value)
    found = rows.groupBy(F.floor(F.col("nth") / size).alias("chunk"))
    items = found.agg(F.array_sort(F.collect_list(F.struct("nth", "__value"))).alias("items"))
    return items.select("chunk", F.transform("items", lambda x: x["__value"]).alias("items"))


def offset_limit(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_distinct(df: DataFrame, group: Sequence[str], name: str, score: str, order: str, k: int) -> DataFrame:
    """The k best rows of different names in each group; of a name the best row, of equal scores the first."""
    best = df.groupBy(*group, name).agg(F.max_by(_row(df), F.struct(F.col(score), -F.col(order))).alias("row"))
    rows = best.select("row.*")
    w = Window.partitionBy(*group).orderBy(F.desc(score), order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resume(todo: DataFrame, done: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """What has no result yet, in order; a failed result counts as one."""
    left = todo.join(done.select(key), key, "left_anti")
    return left.orderBy(order if order is not None else F.col(key))


def by_position(left: DataFrame, position: Column, right: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each row of `left` with the row of `right` that is at the given place of its order."""
    placed = numbered(right, order, "__at")
    return left.withColumn("__at", position.cast("long")).join(placed, "__at").drop("__at")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of both tables; of equal keys the new one."""
    both = old.withColumn("__source", F.lit(0)).unionByName(new.withColumn("__source", F.lit(1)))
    return last_by(both, key, ["__source"]).drop("__source")


def id_suffix(col: Column | str) -> Column:
    """The whole number after the last underscore of an id."""
    return F.element_at(F.split(col, "_"), -1).cast("long")


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
