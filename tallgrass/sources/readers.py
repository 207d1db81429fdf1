"""Readers of catalogs, benchmark records, caches, neighbour files and results.

Order in a file matters (first definitions win), so rows carry `ord`: a number that rises
with file, line and place in the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.operators.relational import first_by, id_suffix, last_definition, numbered

EDGE_SCHEMA = "tool_name string, tool_type string, neighbor_name string, neighbor_type string, similarity double, rank int"
UNTYPED_EDGE_SCHEMA = "tool_name string, neighbor_name string, similarity double, rank int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, value: non-blank lines in order.  Spark numbers lines by partition and place, which rises."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.where(F.trim("value") != "").select(F.col("at").alias("line"), F.trim("value").alias("value"))


def _elements(rows: DataFrame) -> DataFrame:
    """line, pos, json: the elements of arrays, one level down, or the object itself."""
    is_array = F.col("value").startswith("[")
    items = F.when(is_array, F.from_json("value", "array<variant>")).otherwise(F.array(F.try_parse_json("value")))
    found = rows.select("line", F.posexplode(items).alias("pos", "x"))
    nested = F.schema_of_variant("x").startswith("ARRAY")
    inner = F.when(nested, F.from_json(F.to_json("x"), "array<variant>")).otherwise(F.array("x"))
    out = found.select("line", "pos", F.posexplode(inner).alias("pos2", "v"))
    return out.select("line", "pos", "pos2", F.to_json("v").alias("json"))


def load_json_or_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """ord, json: the objects of a file that is one JSON document or one per line.

    A file whose first line doesn't parse by itself is read as one document.  `strict`: a bad
    line is an error; else it is left out.
    """
    lines = _lines(spark, path)
    first = lines.orderBy("line").first()
    single = first is not None and lines.orderBy("line").limit(1).where(F.try_parse_json("value").isNull()).count() == 1
    if single:
        lines = spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("line"), F.trim("value").alias("value"))
    bad = F.try_parse_json("value").isNull()
    if strict:
        message = F.concat(F.lit("not JSON: "), F.substring("value", 1, 80))
        lines = lines.withColumn("value", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("value")))
    else:
        lines = lines.where(~bad)
    return numbered(_elements(lines), ["line", "pos", "pos2"], "ord").select("ord", "json")


def text_at(json: Column, *paths: str) -> Column:
    """The first of several paths that holds a non-empty string."""
    values = [F.try_variant_get(F.try_parse_json(json), p, "string") for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def tools_of(objects: DataFrame) -> DataFrame:
    """ord, name, description, properties, required, parent, json of catalog objects.

    properties: map from name to JSON text of the parameter's schema.  description falls
    back on the first line of the tool's rendering.
    """
    j = F.col("json")
    v = F.try_parse_json(j)
    name = text_at(j, "$.function.name", "$.name")
    description = F.coalesce(F.trim(text_at(j, "$.function.description", "$.description")), F.concat(F.lit("Tool: "), F.coalesce(name, F.lit(""))))
    properties = F.coalesce(F.try_variant_get(v, "$.function.parameters.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    required = F.coalesce(F.try_variant_get(v, "$.function.parameters.required", "array<string>"), F.array().cast("array<string>"))
    return objects.select(
        "ord",
        name.alias("name"),
        description.alias("description"),
        F.transform_values(properties, lambda _, x: F.to_json(x)).alias("properties"),
        required.alias("required"),
        text_at(j, "$._source_tool", "$.created_from", "$.parent", "$.original_tool").alias("parent"),
        "json",
    )


def load_catalog(spark: SparkSession, path: str, keep: str = "first") -> DataFrame:
    """Tools with a name, one of each: the first, the last (at the first's place), or all."""
    tools = tools_of(load_json_or_jsonl(spark, path))
    if keep == "first":
        return first_by(tools.where(F.col("name").isNotNull()), ["name"], ["ord"])
    return last_definition(tools, "name", "ord") if keep == "last" else tools


def load_fixed_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tools of a JSONL file with canonical types; bad lines are left out, of a name the first stays."""
    from tallgrass.functions.schemas import fixed_column

    objects = load_json_or_jsonl(spark, path, strict=False)
    tools = tools_of(objects.withColumn("json", fixed_column(F.col("json"))))
    return first_by(tools.withColumn("name", F.coalesce(text_at(F.col("json"), "$.function.name"), F.lit("unknown"))), ["name"], ["ord"])


def load_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, by_id: bool = False) -> DataFrame:
    """JSONL records; with `by_id` in order of the number at the end of their id."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path)
    return rows.orderBy(id_suffix("id")) if by_id else rows


def load_edges(spark: SparkSession, path: str, typed: bool = True, least: float | None = None) -> DataFrame:
    """Neighbour edges of a CSV file with a header; `least` keeps those of that similarity or more."""
    rows = spark.read.csv(path, header=True, schema=EDGE_SCHEMA if typed else UNTYPED_EDGE_SCHEMA, mode="DROPMALFORMED")
    return rows if least is None else rows.where(F.col("similarity") >= least)


def load_schema_cache(spark: SparkSession, path: str) -> DataFrame:
    """ord, json of the tools of a cache document: {tools: [...]} or a bare list; none if it can't be read."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    tools = F.coalesce(F.try_variant_get("v", "$.tools", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return whole.select(F.posexplode(tools).alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), F.to_json("x").alias("json"))


def load_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """text, v of a JSON object from text to vector."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("text", "v"))


def load_results(spark: SparkSession, folder: str, benchmark: str, models: list[str] | None = None) -> DataFrame:
    """Results of all models under a folder, with the model from each path; `models` by equality."""
    rows = spark.read.json(f"{folder}/*/{benchmark}_result.jsonl")
    found = rows.withColumn("model", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return found if models is None else found.where(F.col("model").isin(models))


def task_rows(records: DataFrame) -> DataFrame:
    """name, ord, text: the tasks of each record under each of its tools (struct arrays tools, tasks)."""
    tools = records.select("id", F.posexplode("tools").alias("at", "name")).where(F.coalesce("name", F.lit("")) != "")
    tasks = records.select("id", F.posexplode("tasks").alias("nth", "text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    both = tools.join(tasks, "id")
    return both.select("name", F.struct(id_suffix("id").alias("id"), "at", "nth").alias("ord"), F.trim("text").alias("text"))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in any store that Spark reads; FileNotFoundError with all of them if none does."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")
