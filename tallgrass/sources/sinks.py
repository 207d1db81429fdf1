"""Writers: CSV, JSON lines, one-row reports, documents, upserts, backups and versioned overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.operators.relational import numbered, settled, upsert


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, skip_empty: bool = False) -> bool:
    """CSV with a header; with `skip_empty` nothing is written for no rows."""
    if skip_empty and df.isEmpty():
        return False
    (df.select(*fields) if fields else df).write.mode("overwrite").csv(path, header=True, escape='"')
    return True


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; parts append where an offset run goes on."""
    df.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def write_json_text(df: DataFrame, path: str, json: str = "json", append: bool = False) -> None:
    """Rows that are JSON text already."""
    df.select(json).write.mode("append" if append else "overwrite").text(path)


def report(spark: SparkSession, **values: Column | int | float | str) -> DataFrame:
    """json: one object of the given values."""
    columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]
    return spark.range(1).select(F.to_json(F.struct(*columns)).alias("json"))


def write_upserted(spark: SparkSession, new: DataFrame, path: str, key: str, order: Column | None = None) -> None:
    """JSON lines by key, the new row of a key in place of the old one.

    The merged rows are settled before the old files go, so that a failure loses nothing.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        new = upsert(spark.read.schema(new.schema).json(path), new, [key])
    rows = settled(new.orderBy(order) if order is not None else new.orderBy(key))
    write_jsonl(rows, path)


def write_versioned(df: DataFrame, path: str, version: str) -> str:
    """Parquet in a folder of its own for each version, so that nothing is overwritten."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_with_backup(df: DataFrame, path: str) -> bool:
    """Parquet in place of what `path` holds, which goes to `path`.backup first, in place of an older backup.

    The rows are settled before anything moves, so that they may come from the old files.  Whether there was a backup.
    """
    spark, rows = df.sparkSession, settled(df)
    old, files = _files(spark, path)
    backup, _ = _files(spark, f"{path}.backup")
    had = files.exists(old)
    if had:
        files.delete(backup, True)
        if not files.rename(old, backup):
            raise OSError(f"can't move {path}")
    rows.write.parquet(path)
    return had


def _plain(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, _: k.cast("string")), lambda _, v: _plain(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    json_kind = isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.VariantType, T.NullType)) and not isinstance(kind, T.DecimalType)
    return value if json_kind else value.cast("string")


def stringified(df: DataFrame) -> DataFrame:
    """The rows with every value that JSON has no kind for, at any depth, as text: dates, times, decimals, bytes, intervals."""
    return df.select(*(_plain(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields))


def write_batch(tools: DataFrame, metadata: DataFrame, path: str, offset: int = 0) -> DataFrame:
    """JSON lines of generated tools (column json) and of what is told of them; the metadata of all batches so far.

    From an offset on, both go on behind what is there, else they begin anew.
    """
    write_json_text(tools, f"{path}/tools", append=offset > 0)
    write_jsonl(metadata, f"{path}/metadata", append=offset > 0)
    return metadata.sparkSession.read.schema(metadata.schema).json(f"{path}/metadata")


def write_document(tools: DataFrame, path: str, **metadata: str) -> int:
    """One JSON document of tools (columns ord and json), their count and metadata, as text files.

    The files' lines, in order of the files' names, are the document, so that no task holds it whole.  The count.
    """
    rows = settled(numbered(tools.select("ord", "json"), ["ord"]))
    n = rows.count()
    told = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()))) if metadata else F.lit("{}")
    line = F.concat("json", F.when(F.col("nth") < n - 1, ",").otherwise(""))
    spark = tools.sparkSession
    ends = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("nth"), F.lit('{"tools": [').alias("value")), F.struct(F.lit(n).cast("long").alias("nth"), F.concat(F.lit(f'], "count": {n}, "metadata": '), told, F.lit("}")).alias("value")))).alias("x"))
    lines = rows.select("nth", line.alias("value")).unionByName(ends.select("x.*"))
    lines.repartitionByRange("nth").sortWithinPartitions("nth").select("value").write.mode("overwrite").text(path)
    return n


def write_transcripts(dialogues: DataFrame, path: str) -> None:
    """Three outputs of one pass over dialogues (id, messages, cleaned, calls): as they were, cleaned, and a row for each call of an agent.

    A dialogue that failed (null messages) is left out of all three; null calls are no rows.
    """
    rows = settled(dialogues.where("messages IS NOT NULL"))
    write_jsonl(rows.select("id", "messages"), f"{path}/origin")
    write_jsonl(rows.select("id", F.col("cleaned").alias("messages")), f"{path}/train")
    write_jsonl(rows.select("id", F.explode("calls").alias("call")).where("call IS NOT NULL").select("id", "call.*"), f"{path}/fetch_data")
