"""Checks of calls beside their tools' schemas: the first error by place in the document.

`sides_column` turns a call's JSON texts into their values in document order, each gold value with the place of the
predicted one that it meets, and `asked_column` a tool's parameters into what is asked at each shape.  Calls meet
their tools by a join, and all else stays in a call's row: built-in expressions over its values find what they break,
and the result is the least by place.  No value moves on its own.  Only the texts of values that differ go through a
small function.  Schemas with anyOf have no such rows; their calls are checked by `schemas.call_error_column`.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import schemas
from tallgrass.operators import relational

#: Called tools, and bytes of their definitions, that are told to the join by broadcast; beyond, the join is by exchange.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null", list: "array", dict: "object"}
#: The step to an array's items in a shape; that to a name is a dot and the name in quotes.
ITEM = "[]"
SAMPLES = {"string": "", "boolean": True, "integer": 1, "number": 0.5, "null": None, "array": [], "object": {}}

_NODE = [("shape", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("same", pa.string())]
_NODE += [("names", pa.list_(pa.string())), ("nths", pa.list_(pa.int32())), ("size", pa.int32()), ("met", pa.int32())]
NODES = "array<struct<shape:string,path:string,kind:string,text:string,same:string,names:array<string>,nths:array<int>,size:int,met:int>>"
_ASKED = pa.struct(
    [("shape", pa.string()), ("kinds", pa.list_(pa.string())), ("enum", pa.list_(pa.string())), ("required", pa.list_(pa.string()))]
    + [("known", pa.list_(pa.string())), ("free", pa.bool_())]
)
DIFFERENT = "array<struct<at:string,plain:string,missing:array<string>,extra:array<string>,predicted:string,gold:string>>"
ASKED = "struct<options:boolean,nodes:array<struct<shape:string,kinds:array<string>,enum:array<string>,required:array<string>,known:array<string>,free:boolean>>>"


_quoted = lru_cache(10_000)(json.dumps)


def canonical(value) -> str | None:
    """Texts are equal where values are; null for what equals nothing."""
    return nodes(value)[0]["same"]


def _canonical(value, below: list[str | None]) -> str | None:
    """`canonical` of a value, with those of the values in it."""
    if isinstance(value, (list, dict)):
        if None in below:
            return None
        if isinstance(value, list):
            return f"[{','.join(below)}]"
        return "{" + ",".join(sorted(f"{_quoted(k)}:{p}" for k, p in zip(value, below))) + "}"
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return str(int(value)) if value.is_integer() else repr(value)
    return str(int(value)) if isinstance(value, int) else _quoted(value)


def nodes(value) -> list[dict]:
    """A JSON value and the values within it, in document order.

    place names the value within the document, shape the same with all items of an array alike; path is for people.
    """
    out: list[dict] = []
    todo: list[tuple] = [(value, "", "", "", None)]
    values = []
    while todo:
        value, place, shape, path, parent = todo.pop()
        row = {"place": place, "shape": shape, "path": path, "kind": KINDS[type(value)], "text": value if isinstance(value, str) else None}
        row |= {"names": [], "nths": [], "size": 0, "met": None}
        if parent is not None:
            parent["nths"].append(len(out))
        out.append(row)
        values.append(value)
        if isinstance(value, dict):
            row["names"] = list(value)
            for k, v in reversed(value.items()):
                step = f".{_quoted(k)}"
                todo.append((v, place + step, shape + step, f"{path}.{k}" if path else k, row))
        elif isinstance(value, list):
            row["size"] = len(value)
            todo += [(v, f"{place}[{i}]", shape + ITEM, f"{path}[{i}]", row) for i, v in reversed(list(enumerate(value)))]
    for row, value in zip(reversed(out), reversed(values)):  # what a value holds comes after it
        row["same"] = _canonical(value, [out[n]["same"] for n in row["nths"]])
    return out


def _array(rows: list[list[dict] | None]) -> pa.Array:
    """The nodes of each row; null for null."""
    flat = [node for row in rows if row is not None for node in row]
    ends = list(accumulate((len(row) if row is not None else 0 for row in rows), initial=0))
    offsets = [None if row is None else at for row, at in zip(rows, ends)] + ends[-1:]
    fields = [pa.array([node[name] for node in flat], kind) for name, kind in _NODE]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [name for name, _ in _NODE]))


def sides_column(predicted: Column, gold: Column) -> Column:
    """p and g, the `nodes` of two JSON texts; null where one can't be parsed.  met: the number of the p at a g's place."""

    @F.arrow_udf(f"struct<p:{NODES},g:{NODES}>")
    def run(*columns: pa.Array) -> pa.Array:
        both = []
        for column in columns:
            out = []
            for own in column.to_pylist():
                try:
                    out.append(None if own is None else nodes(json.loads(own)))
                except json.JSONDecodeError:
                    out.append(None)
            both.append(out)
        for p, g in zip(*both):
            if p and g:
                places = {node["place"]: n for n, node in enumerate(p)}
                for node in g:
                    node["met"] = places.get(node["place"])
        return pa.StructArray.from_arrays([_array(out) for out in both], ["p", "g"])

    # the columns are read within lambdas, into which Spark would copy the function if it were deterministic
    return run.asNondeterministic()(predicted, gold)


def asked(parameters: dict) -> dict:
    """What a tool's parameters ask at each shape; `options` where an anyOf is in the way."""
    top = {"type": "object", "required": parameters.get("required") or [], "properties": parameters.get("properties") or {}}
    out, todo = [], [(top, "")]
    while todo:
        schema, shape = todo.pop()
        if "anyOf" in schema:
            return {"options": True, "nodes": []}
        classes, known = schemas.allowed(schema), schema.get("properties") or {}
        out.append(
            {
                "shape": shape,
                "kinds": [kind for kind, sample in SAMPLES.items() if isinstance(sample, classes)] if classes else None,
                "enum": [c for v in schema["enum"] if (c := canonical(v)) is not None] if "enum" in schema else None,
                "required": list(schema.get("required") or []),
                "known": list(known),
                "free": schema.get("additionalProperties") is True,
            }
        )
        todo += [(sub, f"{shape}.{_quoted(name)}") for name, sub in known.items()]
        if "items" in schema:
            todo.append((schema["items"], shape + ITEM))
    return {"options": False, "nodes": out}


def asked_column(parameters: Column) -> Column:
    @F.arrow_udf(ASKED)
    def run(column: pa.Array) -> pa.Array:
        out = [asked(json.loads(own) or {}) if own is not None else asked({}) for own in column.to_pylist()]
        return pa.array(out, pa.struct([("options", pa.bool_()), ("nodes", pa.list_(_ASKED))]))

    return run(parameters)


def argument_error(values: Column, schema: Column) -> Column:
    """What the first value breaks of its tool's schema, from the call's nodes and a map from shapes to what is asked; else null.

    A value breaks the type, else the enum, else lacks a required name; a name that isn't defined is an error where
    its value stands.  What is below such a value, or a value of another kind, has no schema and comes after it.
    """

    def of(x: Column, nth: Column) -> Column:
        s = F.try_element_at(schema, x["shape"])
        text = lambda kind: F.when(x["shape"] == "", schemas.ERRORS[kind][0]).otherwise(schemas.ERRORS[kind][1])
        own = (
            F.when(s["kinds"].isNotNull() & ~F.array_contains(s["kinds"], x["kind"]), text("type"))
            .when(s["enum"].isNotNull() & ~F.coalesce(F.array_contains(s["enum"], x["same"]), F.lit(False)), text("enum"))
            .when((x["kind"] == "object") & (F.size(F.array_except(s["required"], x["names"])) > 0), text("missing"))
        )
        unknown = F.array_min(F.filter(x["nths"], lambda _, n: ~F.array_contains(s["known"], F.get(x["names"], n))))
        undefined = F.when((x["kind"] == "object") & ~s["free"], unknown)
        return F.when(own.isNotNull(), F.struct(nth.alias("nth"), own.alias("text"))).when(undefined.isNotNull(), F.struct(undefined.alias("nth"), text("undefined").alias("text")))

    return F.array_min(F.transform(values, of))["text"]


def differences(predicted: Column, gold: Column) -> Column:
    """Where gold values differ from the predicted ones that they meet, in document order, as `first_told` reads them."""

    def of(x: Column) -> Column:
        y = F.get(predicted, x["met"])
        like = x["kind"] == y["kind"]
        plain = F.when(~like, schemas.TYPE).when((x["kind"] == "array") & (x["size"] != y["size"]), schemas.LENGTH)
        unequal = ~F.coalesce(x["same"] == y["same"], F.lit(False))
        plain = plain.when(x["kind"].isin("integer", "number", "boolean") & unequal, schemas.VALUE)
        missing, extra = F.array_sort(F.array_except(x["names"], y["names"])), F.array_sort(F.array_except(y["names"], x["names"]))
        names = like & (x["kind"] == "object") & (F.size(missing) + F.size(extra) > 0)
        strings = like & (x["kind"] == "string") & (x["text"] != y["text"])
        at = F.when(x["path"] != "", F.concat(F.lit(" at '"), x["path"], F.lit("'"))).otherwise("")
        found = F.struct(
            at.alias("at"), plain.alias("plain"), F.when(names, missing).alias("missing"), F.when(names, extra).alias("extra"),
            F.when(strings, y["text"]).alias("predicted"), F.when(strings, x["text"]).alias("gold"),
        )
        return F.when(plain.isNotNull() | names | strings, found)

    met = F.filter(gold, lambda x: x["met"].isNotNull())
    return F.filter(F.transform(met, of), lambda d: d.isNotNull()).cast(DIFFERENT)


def first_told(different: Column) -> Column:
    """The text of the first of the differences; strings that are alike enough are none.  Null if there is none."""

    def told(d: dict) -> str | None:
        if d["plain"] is not None:
            return d["plain"] + d["at"]
        if d["missing"] is not None:
            return schemas.KEYS + d["at"] + schemas.keys_difference(d["missing"], d["extra"])
        found = schemas.string_difference(d["predicted"], d["gold"])
        return found and found[0] + d["at"] + found[1]

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([next((text for d in row or () if (text := told(d)) is not None), None) for row in column.to_pylist()], pa.string())

    return run(different)


def _rules(calls: DataFrame, tools: DataFrame) -> tuple[DataFrame, bool, bool]:
    """tool, parameters, asked of the tools that are called, whether they are few, and whether any of them has options."""
    called = calls.select("tool").distinct()
    found = tools.select("tool", "parameters").join(called, "tool", "left_semi").select("tool", "parameters", asked_column(F.col("parameters")).alias("asked"))
    rules = relational.settled(found)
    size = F.coalesce(F.sum(F.octet_length("parameters")), F.lit(0)).alias("size")
    known = rules.agg(F.count(F.lit(1)).alias("n"), size, F.coalesce(F.bool_or("asked.options"), F.lit(False)).alias("options")).first()
    few = known["n"] <= BROADCAST_ROWS and known["size"] <= BROADCAST_BYTES
    return rules, few, known["options"]


def call_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """The calls with `result`: `correct`, or the first error by the tool's schema, or else against the gold arguments.

    calls: id (a key), tool, predicted, gold (JSON texts; a null gold isn't compared); tools: tool (a key),
    parameters (JSON text).  A text that can't be parsed, null too, is bad JSON; a called tool without definition raises.
    """
    rules, few, options = _rules(calls, tools)
    columns = ["id", *(c for c in calls.columns if c != "id")]
    by_shape = F.map_from_arrays(F.transform("asked.nodes", lambda n: n["shape"]), F.col("asked.nodes"))
    known = rules.select("tool", F.col("parameters").alias("__parameters"), F.col("asked.options").alias("__options"), by_shape.alias("__asked"))
    # Spark takes an array for as small as one item, so without a hint it would broadcast any number of definitions
    known = F.broadcast(known) if few else known.hint("merge")
    sides = sides_column(F.col("predicted"), F.col("gold")).alias("__sides")
    if few:  # else the calls move, as texts
        own = calls.select(*columns, sides).join(known, "tool", "left")
    else:
        own = calls.join(known, "tool", "left").select(*columns, "__options", "__asked", sides)
    own = own.where("__options IS NULL OR NOT __options")
    p, g = F.col("__sides.p"), F.col("__sides.g")
    lost = F.raise_error(F.concat(F.lit("no definition of a called tool: "), F.coalesce("tool", F.lit("null"))))
    bad = p.isNull() | (F.col("gold").isNotNull() & g.isNull())
    broken = F.when(F.col("__options").isNull(), lost.cast("string")).when(bad, schemas.BAD_JSON).otherwise(argument_error(p, F.col("__asked")))
    own = own.select(*columns, "__sides", broken.alias("__broken"))
    # what differs is a column of its own, used twice, so that Spark queues that for the function and not the values
    own = own.select(*columns, "__broken", F.when(F.col("__broken").isNull() & g.isNotNull(), differences(p, g)).alias("__different"))
    told = F.when(F.size("__different") > 0, first_told(F.col("__different")))
    found = own.select(*columns, F.coalesce("__broken", told, F.lit(schemas.CORRECT)).alias("result"))
    if options:
        others = schemas.call_error_column(F.col("__parameters"), F.coalesce("predicted", F.lit("")), F.col("gold"))
        found = found.unionByName(calls.join(known, "tool").where("__options").select(*columns, others.alias("result")))
    return found
