"""Benchmark records and model replies as JSON: which tools and tasks a record names, and what a tool takes.

Records are rows of id and json.  All of it is expressions over VARIANT values; a text that can't be parsed names
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "array<variant>"


def _list(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", _LIST)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def chosen(json: Column, field: str, prefix: str = "english_", by: str = "truthy") -> Column:
    """A record's list of variants: the prefixed field, else the plain one, else an empty list.

    by: `truthy` takes the prefixed field if it has elements, `present` if the record has it at all.
    """
    value = F.try_parse_json(json)
    first, other = _list(value, f"{prefix}{field}"), _list(value, field)
    empty = F.array().cast(_LIST)
    if by == "present":
        return F.when(F.array_contains(F.json_object_keys(json), f"{prefix}{field}"), F.coalesce(first, empty)).otherwise(F.coalesce(other, empty))
    return F.when(F.size(first) > 0, first).otherwise(F.coalesce(other, empty))


def tool_name(tool: Column) -> Column:
    """The name of a variant that is a definition, flat or under `function`, or a name itself; null where there is none."""
    text = lambda path: F.nullif(F.try_variant_get(tool, path, "string"), F.lit(""))
    return F.when(_kind(tool) == "STRING", text("$")).when(_kind(tool).startswith("OBJECT"), F.coalesce(text("$.function.name"), text("$.name")))


def task_text(task: Column, strip: bool = True) -> Column:
    """A task as text: a string itself, an object's `input` if that is a string, else JSON text with sorted keys."""
    clean = (lambda c: F.trim(c)) if strip else (lambda c: c)
    own = F.try_variant_get(task, "$", "string")
    inner = F.try_variant_get(task, "$.input", "variant")
    return (
        F.when(_kind(task) == "STRING", clean(own))
        .when(_kind(task).startswith("OBJECT") & (_kind(inner) == "STRING"), clean(F.try_variant_get(task, "$.input", "string")))
        .otherwise(F.to_json(task))
    )


def catalog_tasks(records: DataFrame, catalog: DataFrame, by: str = "truthy", strip: bool = True) -> DataFrame:
    """name, text, ord: the tasks of each record under each of its tools that the catalog (column name) has.

    A tool that a record lists twice has its tasks twice; empty texts are left out where texts are stripped.  ord is
    the record's id, the tool's and the task's place.  A record's lists are met within its row.
    """
    rows = records.select("id", F.posexplode(F.transform(chosen(F.col("json"), "tools", by=by), tool_name)).alias("at", "name"), "json")
    known = rows.join(catalog.select("name").distinct(), "name", "left_semi")
    texts = F.transform(chosen(F.col("json"), "tasks", by=by), lambda t: task_text(t, strip))
    found = known.select("id", "at", "name", F.posexplode(texts).alias("nth", "text"))
    if strip:
        found = found.where(F.col("text") != "")
    return found.select("name", "text", F.struct("id", "at", "nth").alias("ord"))


# ---- what tools take ----


def tool_info(tools: DataFrame) -> DataFrame:
    """name, properties, required, optional from name and json: the names a tool takes, in document order."""
    properties = F.coalesce(F.json_object_keys(F.get_json_object("json", "$.function.parameters.properties")), F.array().cast("array<string>"))
    needed = F.coalesce(F.try_variant_get(F.try_parse_json("json"), "$.function.parameters.required", "array<string>"), F.array().cast("array<string>"))
    rows = tools.select("name", properties.alias("properties"), needed.alias("required"))
    return rows.withColumn("optional", F.filter("properties", lambda p: ~F.array_contains(F.col("required"), p)))


def told_info(info: DataFrame) -> DataFrame:
    """name, told: a sentence for a prompt on what a tool must and may be given."""
    joined = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    text = F.concat(F.lit("Tool "), "name", F.lit(" needs "), joined("required"), F.lit(" and may be given "), joined("optional"), F.lit("."))
    return info.select("name", text.alias("told"))


def input_schema(tool: Column) -> Column:
    """JSON text of a flat definition for models that call the parameters inputSchema; floats are numbers."""
    plain = F.regexp_replace(tool, r'"type"\s*:\s*"float"', '"type": "number"')
    fields = F.transform(
        F.json_object_keys(plain),
        lambda k: F.struct(F.when(k == "parameters", "inputSchema").otherwise(k).alias("key"), F.try_variant_get(F.try_parse_json(plain), F.concat(F.lit("$['"), k, F.lit("']")), "variant").alias("value")),
    )
    return F.to_json(F.map_from_entries(fields))


def generated_tools(reply: Column) -> Column:
    """array<string>: the definitions in a model's reply, one a line, with a type and without `reason`.

    Blank lines, comments, fences, and lines that are no object with a function's name are left out.
    """
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("```"))
    named = F.filter(kept, lambda x: F.coalesce(F.get_json_object(x, "$.function.name"), F.lit("")) != "")

    def whole(line: Column) -> Column:
        fields = F.map_filter(F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>"), lambda k, _: k != "reason")
        typed = F.when(F.map_contains_key(fields, "type"), fields).otherwise(
            F.map_concat(fields, F.create_map(F.lit("type"), F.parse_json(F.lit('"function"'))))
        )
        return F.to_json(typed)

    return F.transform(named, whole)
