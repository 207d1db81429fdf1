"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: whole texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (tests) a temporary folder is made.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallgrass-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here.

    The files outlive any executor, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_tell(df: DataFrame, *told: Column) -> tuple[DataFrame, tuple]:
    """What `cut` gives, and aggregates over its rows, which are observed as they are written: no further job reads them."""
    names = [f"told_{i}" for i in range(len(told))]
    seen = Observation()
    out = cut(df.observe(seen, *[t.alias(n) for t, n in zip(told, names)]))
    found = seen.get
    if any(n not in found for n in names):  # a plan that was found to give no row may observe nothing
        return out, tuple(out.agg(*told).first())
    return out, tuple(found[n] for n in names)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """What `cut` gives, and its number of rows."""
    out, (n,) = cut_and_tell(df, F.count(F.lit(1)))
    return out, n


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote; nothing may read it later."""
    spark = df.sparkSession
    base = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if not folder.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(base).toUri().getPath()):
            raise ValueError(f"not a table of {base}: {folder}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Ids that may be told to a scan by broadcast; 8 bytes each.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, whose doc_id is not in gone(doc_id); a null doc_id is one of them."""
    ids = cut(gone.select("doc_id").distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # else Spark joins by exchange
    ids = ids.withColumnRenamed("doc_id", "gone_id")
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti").select(*docs.columns)


def not_kept(decisions: DataFrame) -> DataFrame:
    """doc_id of decisions(doc_id, kept) of which no row is kept."""
    return decisions.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
