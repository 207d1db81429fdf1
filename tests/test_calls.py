"""Calls in one form, beside gold ones, and with ids."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import calls, curation

CALLS = "id int, calls array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"


def test_normalised(spark):
    rows = [(1, None), (2, []), (3, [(None, "f", None, None), ("x", "g", "{1}", None), ("y", "ignored", None, ("h", "{}"))])]
    found = spark.createDataFrame(rows, CALLS).select("id", calls.normalised(F.col("calls")).alias("c")).collect()
    got = {r["id"]: [(c["id"], c["function"]["name"], c["function"]["arguments"]) for c in r["c"]] for r in found}
    assert got == {1: [], 2: [], 3: [("toolu_bdrk_0", "f", "{}"), ("x", "g", "{1}"), ("y", "h", "{}")]}


def test_normalised_refuses_other_forms(spark):
    rows = spark.createDataFrame([(1, [("x", None, "{}", None)])], CALLS)
    with pytest.raises(Exception, match="a call needs a function or a name"):
        rows.select(calls.normalised(F.col("calls"))).collect()


def test_split_parameters(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "ab"], ["ab", "b", "z"]), (2, ["a"], None), (3, None, ["a"])], "id int, n array<string>, r array<string>")
    found = rows.select("id", calls.split_parameters(F.col("n"), F.col("r")).alias("x")).collect()
    got = {r["id"]: (r["x"]["required"], r["x"]["optional"]) for r in found}
    assert got == {1: (["b", "ab"], ["a"]), 2: ([], ["a"]), 3: ([], [])}


def test_paired(spark):
    shape = "task int, name string, arguments string"
    predicted = spark.createDataFrame([(1, "g", "2"), (1, "f", "9"), (1, "f", "1"), (2, "f", None)], shape)
    gold = spark.createDataFrame([(1, "f", "1"), (1, "g", "2"), (3, "h", "")], shape)
    got = {(r["task"], r["place"]): (r["predicted"] and tuple(r["predicted"]), r["gold"] and tuple(r["gold"])) for r in calls.paired(predicted, gold, ["task"]).collect()}
    assert got == {
        (1, 0): (("f", "1"), ("f", "1")),
        (1, 1): (("f", "9"), ("g", "2")),
        (1, 2): (("g", "2"), None),
        (2, 0): (("f", None), None),
        (3, 0): (None, ("h", "")),
    }


def test_call_ids_are_answered_in_order(spark):
    rows = [(1, 0, "tool", 0), (1, 1, "assistant", 2), (1, 2, "tool", 0), (1, 3, "tool", None), (2, 0, "assistant", 1), (2, 1, "user", 5), (2, 2, "tool", 0)]
    messages = spark.createDataFrame(rows, "conversation int, turn int, role string, calls int")
    got = {(r["conversation"], r["turn"]): r["ids"] for r in calls.with_call_ids(messages).collect()}
    assert len(got) == len(rows) and len(set(got[1, 1])) == 2
    assert got[1, 0] == [] and got[2, 1] == []  # nothing was asked before; users make no calls
    assert [*got[1, 2], *got[1, 3]] == got[1, 1]  # the message that came too early took none
    assert got[2, 2] == got[2, 0]
    assert got == {(r["conversation"], r["turn"]): r["ids"] for r in calls.with_call_ids(messages).collect()}


def test_call_tables_may_be_empty(spark):
    none = spark.createDataFrame([], "task int, name string, arguments string")
    assert calls.paired(none, none, ["task"]).count() == 0
    assert calls.with_call_ids(spark.createDataFrame([], "conversation int, turn int, role string, calls int")).count() == 0


def test_each_tool_is_counted_under_the_first_rule_it_breaks(spark):
    synthetic = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("c", "p", 2), ("d", "q", 3), ("e", "q", 4)], "tool_name string, parent string, ord int")
    original = spark.createDataFrame([("a",), ("p",), ("q",)], "tool_name string")
    edge = lambda x, y, kind, rank: (x, "synthetic", y, kind, 0.9, rank)
    edges = spark.createDataFrame(
        [edge("a", "q", "original", 1), edge("b", "q", "original", 1), edge("c", "d", "synthetic", 1), edge("d", "c", "synthetic", 1), edge("e", "q", "original", 1)],
        "tool_name string, tool_type string, neighbor_name string, neighbor_type string, raw double, rank int",
    )
    found = curation.judged(synthetic, original, edges)
    assert {r["tool_name"]: r["rule"] for r in found.collect()} == {"a": 1, "b": 2, "c": 3, "d": 3, "e": 0}
    assert curation.gold_report(original, found).first().asDict() == {"original": 3, "synthetic": 5, "rule1": 1, "rule2": 1, "rule3": 2, "kept": 1, "gold": 4}
