"""Result files to labels and metrics, on hand-made logs."""

import json

from tallgrass.operators import dag
from tallgrass.plans import commands

SINGLE, MIXED, CHAT = "Single-Tool", "Mixed Multi-Tool", "Chat"


def tool(name, kind="integer"):
    return {"type": "function", "function": {"name": name, "parameters": {"type": "object", "properties": {"x": {"type": kind}}, "required": ["x"]}}}


def step(label, predicted, gold):
    calls = [{"id": "c", "function": {"name": n, "arguments": json.dumps(a)}} for n, a in predicted]
    answer = {"action": [{"name": n, "arguments": json.dumps(a)} for n, a in gold]}
    return {
        "inference_input": {"messages": [], "tools": []},
        "inference_output": {"content": "", "tool_calls": calls or None, "current_action_name_label": label},
        "inference_answer": {"candidate_0_answer_function_list": answer},
    }


def task(label, best, *steps):
    log = {"task_idx": 0, "begin_of_current_task": {}} | {f"step_{i}": s for i, s in enumerate(steps)}
    return {"action_name_label": label, "is_optimal": best, "inference_log": log, "latency": [0.1]}


F1, F2 = ("f", {"x": 1}), ("f", {"x": 2})
RIGHT = step("correct", [F1, ("g", {"x": 1.5})], [("g", {"x": 1.5}), F1])
WRONG = step("correct", [F2], [F1])
LOST = step("error", [("h", {})], [F1])
ASKED = step("correct", [], [(dag.ASK, {"tool_name": "f"})])
DONE = step("correct", [], [(dag.ANSWER, {})])


def record(id_, kinds, subtypes, steps):
    tools = [tool("f"), tool("g", "float")]
    return {"id": id_, "english_tools": tools, "english_task_types": kinds, "english_turn_subtypes": subtypes, "english_answer_list": [[{"action": {}}] * n for n in steps]}


RECORDS = [
    record("b_0", [SINGLE, MIXED, CHAT], ["Partial Information", "Long-Range Dependency"], [2, 3, 1]),
    record("b_1", [MIXED, SINGLE], ["Partial Information"], [3, 1]),
    record("b_2", [SINGLE], [], [1]),
    record("b_3", [SINGLE], [], [1]),  # has no result line
]
RESULTS = [
    {"id": "b_0", "result": [task("correct", True, ASKED, RIGHT, DONE), task("error", False, RIGHT, LOST), task("correct", True, DONE)]},
    # wrong arguments, then two more steps: the next is struck and the name counts as correct; wrong ones on the last step
    {"id": "b_1", "result": [task("error", True, WRONG, RIGHT, LOST), task("correct", True, WRONG)]},
    {"id": "b_2", "result": "Error during inference: late"},
]


def table(spark, rows):
    return spark.createDataFrame([(r["id"], json.dumps(r)) for r in rows], "id string, json string")


def test_score(spark):
    found = commands.score(table(spark, RESULTS), table(spark, RECORDS))
    labels = {(r["dialogue"], r["pos"]): (r["name_label"], r["arguments_label"], r["is_optimal"], r["done"], r["struck"], r["label"]) for r in found["labels"].collect()}
    assert labels == {
        ("b_0", 0): ("correct", "correct", True, 3, None, "correct"),
        ("b_0", 1): ("error", None, False, 2, None, "error"),
        ("b_0", 2): ("correct", "correct", True, 1, None, "correct"),
        ("b_1", 0): ("correct", "error", False, 2, 1, "error"),
        ("b_1", 1): ("correct", "error", False, 1, None, "error"),
        ("b_2", 0): ("error", None, False, 0, None, "error"),
    }
    metrics = {name: {r["key"]: (r["correct"], r["total"]) for r in found[name].collect()} for name in ("total", "type", "layer", "turn", "optimal", "progress")}
    assert metrics["total"] == {"task": (2, 6), "session": (0, 3)}
    assert metrics["type"] == {SINGLE: (1, 3), MIXED: (0, 2), CHAT: (1, 1), "Multi-Tool": (0, 2)}
    assert metrics["layer"] == {"0": (1, 3), "1": (0, 2), "2": (1, 1), "3": (0, 0)}
    assert metrics["turn"]["First Turn"] == (1, 3) and metrics["turn"]["Subsequent Turn"] == (1, 3) and metrics["turn"]["Partial Information"] == (0, 2)
    assert metrics["optimal"][MIXED] == metrics["optimal"]["Total"] == (0, 2)
    assert metrics["progress"][MIXED] == metrics["progress"]["Total"] == (4, 6)


def test_score_of_nothing(spark):
    found = commands.score(table(spark, RESULTS).where("id = 'none'"), table(spark, RECORDS))
    assert found["labels"].count() == 0 and {r["total"] for r in found["layer"].collect()} == {0}
