"""Plain functions and small tables with hand-made expectations."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import schemas, text
from tallgrass.operators import dag, dialogue, relational, retrieval, terms, vectors


@pytest.mark.parametrize(
    "names, deps, expected",
    [
        ("abc", [[], [0], [1]], [[[0], [1], [2]]]),
        ("abc", [[], [], [0, 1]], [[[0], [1], [2]], [[1], [0], [2]], [[0, 1], [2]]]),
        ("ffc", [[], [], [0, 1]], [[[0], [1], [2]], [[0, 1], [2]]]),
        ("ffg", [[], [], []], [[[0], [1], [2]], [[2], [0], [1]], [[2], [0, 1]], [[0, 1], [2]], [[0, 1, 2]]]),
    ],
)
def test_paths(names, deps, expected):
    assert dag.paths(list(names), deps) == expected


def test_more_paths():
    found = dag.paths(list("abc"), [[], [], []])
    assert len(found) == 13 and len(dag.optimal(found)) == 1
    with pytest.raises(ValueError):
        dag.paths(list("abcdef"), [[]] * 6, most=10)
    assert dag.paths([], []) == [[]]
    assert dag.levels([[], [0], [1, 0], [4], [3]]) == [0, 1, 2, -1, -1]


def test_replay():
    names, deps = list("abc"), [[], [], [0, 1]]
    assert dag.replay(names, deps, [["b", "a"], ["c"]]) == ("correct", 1, None)
    assert dag.replay(names, deps, [["a"], ["c"]]) == ("error", 1, 1)
    assert dag.replay(names, deps, [[]])[0] == "error"
    assert dag.is_optimal("correct", 1, deps) and not dag.is_optimal("correct", 2, deps)


@pytest.mark.parametrize(
    "value, gold, expected",
    [
        ({"n": 1}, {"n": 1.0}, "error_match: value type inconsistent at 'n'"),
        ({"c": " New York "}, {"c": "newyork"}, "correct"),
        ({"c": "Beijng"}, {"c": "Beijing"}, "error_match: string similarity too low at 'c' (rouge score: 0.00)"),
        ([1, 2], [1], "error_match: array length mismatch"),
        ({"a": 1}, {"b": 1}, "error_match: args keys mismatch (missing: ['b'], extra: ['a'])"),
        (True, 1, "error_match: value type inconsistent"),
        ("", "abcdefghijkl", "error_match: rouge calculation failed"),
    ],
)
def test_values(value, gold, expected):
    assert schemas.value_error(value, gold) == expected


def test_arguments():
    error = schemas.argument_error
    assert error(True, {"type": "integer"}) is None
    assert error({}, {"type": "object", "required": ["x"]}) == "error_schema: required args missing"
    nested = {"type": "object", "properties": {"x": {"type": "object", "properties": {"y": {"enum": ["a"]}}}}}
    assert error({"x": {"y": "b"}}, nested) == "error_schema: nested args value not in enum"
    assert error({"x": {"z": 1}}, nested) == "error_schema: nested args not defined"
    assert error(3, {"anyOf": [{"type": "string"}, {"type": "integer"}]}) is None
    assert error([1, "a"], {"type": "array", "items": {"type": "integer"}}) == "error_schema: nested args type inconsistent"
    assert error("a", {"type": "strange"}) is None


def test_definitions():
    tool = {"type": "function", "function": {"name": "t", "parameters": {"type": "dict", "properties": {"a": {"type": "list", "items": {"type": "int"}}}}}}
    assert schemas.fixed_tool(tool)["function"]["parameters"]["properties"]["a"] == {"type": "array", "items": {"type": "integer"}}
    assert len(schemas.definition_errors(tool)) == 5
    assert schemas.definition_errors({}) == ["Invalid type: None (expected 'function')", "Missing 'function' field"]


def test_rouge_and_ratio():
    assert text.rouge_l("a b c d", "a b c d") == pytest.approx(1.0)
    assert text.rouge_l("a b", "c d") == 0.0
    assert text.ratio("Beijng", "Beijing") == pytest.approx(0.923, abs=1e-3)
    assert text.han_spaced("我爱x") == "我 爱 x"


def test_flat_errors_agree_with_the_plain_check(spark):
    values = ['{"n": 1}', '{"n": "a"}', "{}", '{"n": 2, "s": "z"}', '{"n": 2, "s": "a"}', '{"n": 2, "q": 1}', "x", "[1]", '{"n": true}']
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "s": {"type": "string", "enum": ["a"]}}}
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select("v", schemas.flat_errors(F.col("v"), ["n"], {"n": "integer", "s": "string"}, {"s": ["a"]}).alias("e")).collect()
    for r in got:
        try:
            expected = schemas.argument_error(json.loads(r["v"]), schema) or "correct"
        except json.JSONDecodeError:
            expected = schemas.BAD_JSON
        assert r["e"] == expected, r


def test_tokens(spark):
    row = spark.createDataFrame([("The naïve foo_bar 123 a1b ab übung Search_x",)], "t string")
    assert row.select(text.tokens(F.col("t"))).first()[0] == ["foo_bar", "a1b", "search_x"]


def test_numbering_does_not_depend_on_partitions(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    for parts in (1, 4, 16):
        got = relational.numbered(rows.repartition(parts), ["x"]).collect()
        assert sorted((r["x"], r["nth"]) for r in got) == [(i, i) for i in range(100)]


def test_first_and_last(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 4)], "ord int, name string, x int")
    first = relational.first_by(rows.where("name IS NOT NULL"), ["name"], ["ord"])
    assert sorted((r["name"], r["x"]) for r in first.collect()) == [("a", 1), ("b", 2)]
    last = relational.last_definition(rows, "name", "ord").collect()
    assert sorted((r["name"], r["x"], r["ord"]) for r in last) == [("a", 3, 0), ("b", 2, 1)]


def test_neighbours_in_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    whole = {(r["query"], r["rank"]): r["item"] for r in vectors.neighbours(table, 3).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 10)
    parts = {(r["query"], r["rank"]): r["item"] for r in vectors.neighbours(table, 3).collect()}
    assert whole == parts and len(whole) == 61 * 3
    assert whole[60, 1] == 0  # all similarities are 0: the lowest ids


def test_kmeans_and_count(spark):
    rows = [(i, [float(i % 2 * 10), i / 100]) for i in range(20)]
    got = terms.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), 2).collect()
    sides = {r["id"] % 2: r["cluster"] for r in got}
    assert len(set(sides.values())) == 2 and all(r["cluster"] == sides[r["id"] % 2] for r in got)
    assert [terms.cluster_count(*x) for x in ((0, 4), (0, 10_000), (7, 3), (0, 1))] == [3, 20, 3, 2]


def test_retrieval_modes(spark):
    messages = spark.createDataFrame(
        [("r", 0, "user", "first"), ("r", 1, "assistant", "x"), ("r", 2, "user", "y"), ("s", 0, "system", "z")],
        "request string, turn int, role string, content string",
    )
    tools = spark.createDataFrame([(i, f"t{i % 7}", [float(i), 1.0]) for i in range(8)], "ord long, name string, v array<double>")
    one = lambda q: q.select(F.when(F.col("request") == "r", 1).otherwise(2).cast("long").alias("request"), F.array(F.lit(1.0), F.lit(0.1)).alias("v"))
    models = retrieval.Models(
        embed=one,
        choose=lambda q: q.select("request", F.array(F.lit("t3"), F.lit("t1"), F.lit("no")).alias("names")),
        rerank=lambda c, q: c.select("request").distinct().withColumn("reply", F.lit("so: [6, 0, 6, 99]")),
    )
    assert {r["query"] for r in retrieval.last_user_query(messages).collect()} == {"y", ""}
    for mode in retrieval.MODES:
        got = retrieval.select(mode, messages, tools, models).collect()
        per = [sorted((r["rank"], r["name"]) for r in got if r["request"] == k) for k in sorted({r["request"] for r in got})]
        assert len(per) == 2 and per[0] == per[1]
        expected = {"in_context": 8, "hierarchical": 2}.get(mode, 2 if mode.endswith("reranker") else 5)
        assert len(per[0]) == expected, mode
    with pytest.raises(ValueError):
        retrieval.select("other", messages, tools, models)


def test_plan_rules(spark):
    tools = spark.createDataFrame([("t", ["a", "b"], ["a"]), (dialogue.ASK, ["tool_name", "missing_required_parameters"], ["tool_name"]), (dialogue.ANSWER, ["answer_type"], ["answer_type"])], "name string, properties array<string>, required array<string>")
    cases = {
        1: ([("t", {"a": "1"})], []),
        2: ([("t", {"b": "1"})], ["missing required"]),
        3: ([("t", {"a": ""})], ["empty required"]),
        4: ([("u", {})], ["unknown tool"]),
        5: ([("t", {"a": "1", "c": "2"})], ["unknown argument"]),
        6: ([], ["empty"]),
        7: (None, ["format"]),
        8: ([(dialogue.ANSWER, {"answer_type": "chat"}), ("t", {"a": "1"})], ["control not alone"]),
        9: ([(dialogue.ANSWER, {"answer_type": "chat"})], ["chat after tool"]),
        10: ([(dialogue.ANSWER, {"answer_type": "x"})], ["answer type"]),
        11: ([(dialogue.ASK, {"tool_name": "t", "missing_required_parameters": '["b"]'})], ["asked not required"]),
        12: ([(dialogue.ASK, {"tool_name": "v", "missing_required_parameters": '["a"]'})], ["asked unknown tool"]),
        13: ([(dialogue.ASK, {"tool_name": "t", "missing_required_parameters": '["a"]'})], []),
    }
    rows = spark.createDataFrame([(i, a) for i, (a, _) in cases.items()], "id int, actions array<struct<name:string,arguments:map<string,string>>>")
    got = dialogue.plan_errors(F.lit(""), F.lit(""), F.col("actions"), F.lit(True), tools, rows).collect()
    assert {r["id"]: r["errors"] for r in got} == {i: e for i, (_, e) in cases.items()}


def test_dialogue_helpers(spark):
    row = spark.range(1).select(
        dialogue.draw_answer(F.lit('```json\n{"a": "x"}\n```'), "User: ", F.lit(1)).alias("a"),
        dialogue.filled("Hi {{{who}}}", who=F.lit("you")).alias("b"),
        dialogue.random_moment(2024, F.lit(5)).alias("c"),
        dialogue.is_tool_result(F.lit("Tool：x")).alias("d"),
    ).first()
    assert (row["a"], row["b"], row["c"][:4], row["d"]) == ("User: x", "Hi you", "2024", True)


def test_broken_definitions():
    head = {"type": "function"}
    assert schemas.definition_errors(head | {"function": None}) == ["Missing 'function' field"]
    named = {"name": "n", "description": "d"}
    assert schemas.definition_errors(head | {"function": named | {"parameters": None}}) == ["Missing function parameters"]
    assert schemas.definition_errors(head | {"function": named | {"parameters": {"type": "object", "properties": None}}}) == []


def test_lists_of_types():
    schema = {"type": "object", "properties": {"x": {"type": ["string", "null"]}, "y": {"type": ["string", "odd"]}}}
    assert schemas.argument_error({"x": None, "y": 1}, schema) is None
    assert schemas.argument_error({"x": "a"}, schema) is None
    assert schemas.argument_error({"x": 1}, schema)


def test_replay_beyond_all_paths(spark):
    """Nine independent calls have more than MOST_PATHS executions, which matching doesn't list; a broken graph is an error text."""
    kind = "id int, nodes array<struct<name:string,deps:array<int>>>, told array<array<string>>"
    rows = [(1, [(c, []) for c in "abcdefghi"], [list("ihgfedcba")]), (2, [("a", [])], [["a"]]), (3, [("a", [7])], [["a"]]), (4, None, None)]
    got = spark.createDataFrame(rows, kind).select("id", dag.replay_column(F.col("nodes"), F.col("told")).alias("x")).select("id", "x.*")
    first, second, third, fourth = sorted(got.collect())
    assert first["label"] == second["label"] == "correct" and first["is_optimal"] and first["error"] is second["error"] is None
    assert third["label"] is None and third["error"] and fourth["label"] == "error"
