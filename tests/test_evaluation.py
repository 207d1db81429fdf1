"""Matching, labels, replay, queues, schema checks and the greedy rule against plain versions that list or scan everything."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import schemas
from tallgrass.operators import call_checks, calls, curation, dag, evaluation

# ---- graphs ----


def replay_over_paths(names, found, predicted):
    """The label by keeping all executions that agree with the steps so far."""
    alive = found
    for step, told in enumerate(predicted):
        here = [p[step] for p in alive if step < len(p)]
        if told is None:
            hit = next((k for k in ({names[i] for i in nodes} & {dag.ASK, dag.ANSWER} for nodes in here) if k), None)
            if hit is None:
                return "error", step, step
            if dag.ANSWER in hit:
                return "correct", step, None
            continue
        match = next((nodes for nodes in here if told and sorted(names[i] for i in nodes) == sorted(told)), None)
        if match is None:
            return "error", step, step
        alive = [p for p in alive if step < len(p) and p[step] == match]
        if any(names[i] == dag.ANSWER for i in match) or all(len(p) == step + 1 for p in alive):
            return "correct", step, None
    return "error", len(predicted), len(predicted)


@pytest.mark.parametrize("kinds", ["fg", "fgh", ["f", "g", dag.ASK, dag.ANSWER]])
def test_walks_equal_all_executions(kinds):
    rnd = random.Random(str(kinds))
    for _ in range(1200):
        size = rnd.randint(0, 5)
        names = [rnd.choice(kinds) for _ in range(size)]
        deps = [[j for j in range(i) if rnd.random() < rnd.choice([0, 0.3, 0.6])] for i in range(size)]
        if size > 1 and rnd.random() < 0.05:
            deps[0] = [size - 1]
        found = dag.paths(names, deps)
        if found and size:
            assert dag.schedule(names, deps) == dag.optimal(found)[0]
            assert dag.shortest_length(deps) == len(dag.optimal(found)[0])
        for _ in range(3):
            if found and rnd.random() < 0.7:
                told = [[names[i] for i in step] for step in rnd.choice(found)]
                told = [None if s in ([dag.ASK], [dag.ANSWER]) and rnd.random() < 0.8 else rnd.sample(s, len(s)) for s in told]
                if told and rnd.random() < 0.3:
                    told[rnd.randrange(len(told))] = [rnd.choice("fg")]
            else:
                told = [rnd.choice([None, [], ["f"], ["g", "f"], ["f", "f"], ["f", "f", "g"]]) for _ in range(rnd.randint(0, 4))]
            assert dag.replay(names, deps, told) == replay_over_paths(names, found, told)


def test_many_independent_calls():
    names = [f"t{i}" for i in range(40)]
    assert dag.replay(names, [[]] * 40, [names[::-1]]) == ("correct", 0, None)
    assert dag.replay(names, [[]] * 40, [[n] for n in names]) == ("correct", 39, None)
    assert dag.schedule(["f"] * 40, [[]] * 40) == [list(range(40))]
    assert dag.replay(["a", "b"], [[1], [0]], [["a"]])[0] == "error" and dag.schedule(["a", "b"], [[1], [0]]) == []
    with pytest.raises(ValueError):
        dag.replay(["a"], [[3]], [["a"]])


def test_columns_over_paths(spark):
    found = [[[0], [1], [2]], [[1], [0], [2]], [[0, 1], [2]]]
    row = spark.createDataFrame([(found, ["b", "a", "c"])], "p array<array<array<int>>>, names array<string>")
    got = row.select(
        dag.prune(F.col("p"), F.lit(0), F.array(F.lit(0), F.lit(1))).alias("kept"),
        dag.shortest(F.col("p")).alias("short"),
        dag.step_candidates(F.col("p"), F.col("names"), F.lit(0)).alias("names"),
    ).first()
    assert got["kept"] == [found[2]] == got["short"] and got["names"] == [["b"], ["a"], ["a", "b"]]


# ---- labels ----


def walked(name, best, steps):
    """One task's log, step by step."""
    log, arguments, struck = list(range(len(steps))), "correct", None
    for i, (step_name, wrong, control) in enumerate(steps):
        if arguments == "error":
            name, struck = "correct", i
            log.remove(i)
            break
        if step_name == "error":
            break
        if wrong and not control:
            arguments = "error"
    told = arguments if name == "correct" else None
    if told == "error":
        best = False
    return name, told, best, len(log), struck, "correct" if name == told == "correct" else "error"


def test_task_labels(spark):
    rnd = random.Random(8)
    logs = {t: (rnd.choice(["correct", "error"]), rnd.random() < 0.5, [(rnd.choice(["correct"] * 3 + ["error"]), rnd.random() < 0.3, rnd.random() < 0.2) for _ in range(rnd.randint(0, 5))]) for t in range(300)}
    tasks = spark.createDataFrame([(t, n, b) for t, (n, b, _) in logs.items()], "task int, name_label string, is_optimal boolean")
    steps = [(t, 2 * i, n, c) for t, (_, _, own) in logs.items() for i, (n, _, c) in enumerate(own)]  # steps needn't be gapless
    pairs = [(t, 2 * i, k, "error" if w and k == 1 else "correct") for t, (_, _, own) in logs.items() for i, (_, w, _) in enumerate(own) for k in range(2)]
    steps = spark.createDataFrame(steps, "task int, step int, name_label string, control boolean")
    pairs = spark.createDataFrame(pairs, "task int, step int, place int, result string")
    got = {r["task"]: (r["name_label"], r["arguments_label"], r["is_optimal"], r["steps"], None if r["struck"] is None else r["struck"] // 2, r["label"]) for r in evaluation.task_labels(tasks, evaluation.step_labels(steps, pairs)).collect()}
    assert got == {t: walked(*own) for t, own in logs.items()}
    assert evaluation.task_labels(tasks.where("task < 0"), evaluation.step_labels(steps, pairs)).count() == 0


TOOLS = [("f", json.dumps({"properties": {"x": {"type": "integer"}}, "required": ["x"]})), ("g", json.dumps({"properties": {"y": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}))]


def test_checked_pairs(spark):
    shape = "task int, name string, arguments string"
    predicted = [(1, "g", '{"y": null}'), (1, "f", '{"x": 2}'), (1, "f", '{"x": 1}'), (2, "f", '{"x": "1"}'), (3, "g", '{"y": 1}'), (4, "f", "bad"), (5, "f", '{"x": 1}')]
    gold = [(1, "f", '{"x": 1}'), (1, "f", '{"x": 3}'), (1, "g", '{"y": null}'), (2, "f", '{"x": 1}'), (3, "g", '{"y": "a"}'), (4, "f", '{"x": 1}'), (5, "f", '{"x": 1}')]
    tools = spark.createDataFrame(TOOLS, "name string, parameters string")
    run = lambda p, g, t=tools: evaluation.checked_pairs(spark.createDataFrame(p, shape), spark.createDataFrame(g, shape), t, ["task"])
    got = {(r["task"], r["place"]): (r["name"], r["result"]) for r in run(predicted, gold).collect()}
    assert got == {
        (1, 0): ("f", "correct"),
        (1, 1): ("f", "error_match: value mismatch at 'x'"),
        (1, 2): ("g", "correct"),
        (2, 0): ("f", "error_schema: nested args type inconsistent"),
        (3, 0): ("g", "error_schema: nested args type inconsistent"),
        (4, 0): ("f", "error: args invalid json format"),
        (5, 0): ("f", "correct"),
    }
    with pytest.raises(Exception, match="other calls than the gold one"):
        run([(1, "f", "{}")], [(1, "g", "{}")]).collect()
    with pytest.raises(Exception, match="no definition of a called tool"):
        run([(1, "h", "{}")], [(1, "h", "{}")]).collect()
    assert run([], []).count() == 0


# ---- documents as rows ----


def a_value(rnd, depth=0):
    kind = rnd.choice("sifbnlo" if depth < 3 else "sifb")
    if kind == "l":
        return [a_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    if kind == "o":
        return {rnd.choice(["a", "b", "c.d", "[]"]): a_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    return {"s": rnd.choice(["", "a", "b c", "B  C", "hello world, a long text", "北京"]), "i": rnd.choice([0, 1, 2]), "f": rnd.choice([1.0, 0.5, 2.0]), "b": rnd.random() < 0.5, "n": None}[kind]


def a_schema(rnd, depth=0, options=False):
    if options and rnd.random() < 0.15:
        return {"anyOf": [a_schema(rnd, depth + 1, True) for _ in range(rnd.randint(1, 2))]}
    out = {}
    if rnd.random() < 0.85:
        out["type"] = rnd.choice(["string", "integer", "number", "boolean", "array", "object", "null", "odd", ["string", "null"], ["integer", "object"]])
    if rnd.random() < 0.15:
        out["enum"] = [a_value(rnd, 2) for _ in range(2)]
    if depth < 3 and rnd.random() < 0.6:
        out["properties"] = {k: a_schema(rnd, depth + 1, options) for k in rnd.sample(["a", "b", "c.d", "[]"], rnd.randint(0, 3))}
        if rnd.random() < 0.4:
            out["required"] = rnd.sample("ab", 1)
        if rnd.random() < 0.4:
            out["additionalProperties"] = rnd.random() < 0.6
    if depth < 3 and rnd.random() < 0.5:
        out["items"] = a_schema(rnd, depth + 1, options)
    return out


def fitting(rnd, schema):
    """A value that mostly has the schema's form."""
    if rnd.random() < 0.12 or "anyOf" in schema:
        return a_value(rnd)
    if "enum" in schema and rnd.random() < 0.7:
        return rnd.choice(schema["enum"])
    kind = schema.get("type", "string")
    kind = rnd.choice(kind) if isinstance(kind, list) else kind
    if kind == "object":
        return {k: fitting(rnd, s) for k, s in schema.get("properties", {}).items()}
    if kind == "array":
        return [fitting(rnd, schema.get("items", {})) for _ in range(rnd.randint(0, 2))]
    return {"string": "b c", "integer": 2, "number": 0.5, "boolean": True, "null": None}.get(kind, "x")


def test_call_errors_equal_the_check_of_one_call(spark, monkeypatch):
    rnd = random.Random(6)
    tools = {f"t{t}": {"properties": {k: a_schema(rnd, 1, t % 5 == 0) for k in rnd.sample(["a", "b", "c.d"], rnd.randint(0, 3))}, "required": rnd.sample("ab", rnd.choice([0, 0, 1]))} for t in range(40)}
    rows = []
    for i in range(1500):
        tool = f"t{rnd.randrange(40)}"
        own = {"type": "object", "properties": tools[tool]["properties"]}
        p = fitting(rnd, own)
        g = p if rnd.random() < 0.4 else fitting(rnd, own)
        p = json.dumps(p) if rnd.random() < 0.97 else rnd.choice(["[1]", "no json", '{"a": NaN}', "1"])
        rows.append((i, tool, p, json.dumps(g) if rnd.random() < 0.9 else rnd.choice([None, "bad{", '{"a": NaN}'])))
    table = spark.createDataFrame(rows, "id long, tool string, predicted string, gold string")
    definitions = spark.createDataFrame([(t, json.dumps(p)) for t, p in tools.items()], "tool string, parameters string")
    want = {i: schemas.call_error(tools, t, p, g) for i, t, p, g in rows}
    assert len(set(want.values())) > 15
    assert {r["id"]: r["result"] for r in call_checks.call_errors(table, definitions).collect()} == want
    monkeypatch.setattr(call_checks, "BROADCAST_ROWS", 3)  # beyond it the schemas come by exchange
    few = table.where("id < 200")
    assert {r["id"]: r["result"] for r in call_checks.call_errors(few, definitions).collect()} == {i: e for i, e in want.items() if i < 200}


def test_call_errors_of_odd_rows(spark):
    definitions = spark.createDataFrame([("f", None), ("g", "{}")], "tool string, parameters string")
    deep = "[" * 200 + "]" * 200
    rows = [(1, "f", None, None), (2, "f", "{}", "{}"), (3, "g", '{"a": 1}', None), (4, "g", "", None), (5, "g", "{}", f'{{"a": {deep}}}')]
    got = call_checks.call_errors(spark.createDataFrame(rows, "id int, tool string, predicted string, gold string"), definitions).collect()
    assert {r["id"]: r["result"] for r in got} == {
        1: schemas.BAD_JSON, 2: "correct", 3: "error_schema: args not defined", 4: schemas.BAD_JSON, 5: "error_match: args keys mismatch (missing: ['a'])"
    }


def test_definitions_that_no_call_names_are_left_out_and_many_are_not_broadcast(spark, monkeypatch):
    definitions = spark.range(300).selectExpr("concat('t', id) AS tool", "concat('{\"properties\": {\"a', id % 7, '\": {\"type\": \"integer\"}}}') AS parameters")
    table = spark.range(50).selectExpr("id", "concat('t', id % 20) AS tool", "concat('{\"a', id % 7, '\": 1}') AS predicted", "CAST(null AS string) AS gold")
    rules, few, options = call_checks._rules(table, definitions)
    assert (rules.count(), few, options) == (20, True, False)
    want = {i: "correct" if i % 20 % 7 == i % 7 else "error_schema: args not defined" for i in range(50)}
    monkeypatch.setattr(call_checks, "BROADCAST_BYTES", 100)
    found = call_checks.call_errors(table, definitions)
    assert {r["id"]: r["result"] for r in found.collect()} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# ---- replay ----


def plain_history(tasks):
    """All tasks of one dialogue by listing all executions."""
    out = [("system", f"Current Date: {tasks[0][2]}", [])]
    for _, _, _, text, answers in tasks:
        out.append(("user", text, []))
        names = [a[0] for a in answers]
        for step in dag.optimal(dag.paths(names, [a[4] for a in answers]))[0] if answers else []:
            own = [answers[i] for i in step]
            if own[0][0] == dag.ASK:
                out += [("assistant", own[0][2], []), ("user", own[0][3], [])]
            elif own[0][0] == dag.ANSWER:
                out.append(("assistant", own[0][2], []))
            else:
                out.append(("assistant", "", [(a[0], a[1]) for a in own]))
                out += [("tool", a[2], []) for a in own]
    return out


ANSWERS = "dialogue int, task int, env string, text string, answers array<struct<name:string,arguments:string,observation:string,user_input:string,deps:array<int>>>"


def test_history(spark):
    rnd, rows = random.Random(4), []
    for dialogue in range(12):
        for task in range(rnd.randint(1, 4)):
            size = rnd.randint(0, 4)
            answers = [(rnd.choice("fg"), f'{{"n": {i}}}', f"seen {i}", None, [j + 1 for j in range(i) if rnd.random() < 0.4]) for i in range(size)]
            answers = [(dag.ASK, "{}", "which?", "that", []), *((n, a, o, u, [0, *d]) for n, a, o, u, d in answers)]
            answers.append((dag.ANSWER, "{}", "done", None, list(range(len(answers)))))
            rows.append((dialogue, task, f"day {dialogue}", f"do {task}", answers if rnd.random() < 0.9 else []))
    tasks = spark.createDataFrame(rows, ANSWERS)
    got: dict = {}
    for r in evaluation.history(tasks).orderBy("dialogue", "number").collect():
        own = got.setdefault(r["dialogue"], [])
        assert r["number"] == len(own)
        own.append((r["role"], r["content"], [tuple(c) for c in r["calls"]]))
    assert got == {d: plain_history([r for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    together = evaluation.history(tasks.where("dialogue = 0"), consecutive=False).where("role = 'tool'").collect()
    assert all(isinstance(json.loads(r["content"]), list) for r in together)
    assert evaluation.history(tasks.where("task < 0")).count() == 0
    mixed = spark.createDataFrame([(1, 1, "", "", [(dag.ASK, "{}", "", "", []), ("f", "{}", "", None, [])])], ANSWERS)
    with pytest.raises(Exception, match="a control action beside others"):
        evaluation.history(mixed).collect()
    circle = spark.createDataFrame([(1, 1, "", "", [("f", "{}", "", None, [0])])], ANSWERS)
    with pytest.raises(Exception, match="answers without an order"):
        evaluation.history(circle).collect()


# ---- queues ----


def test_queues(spark):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["assistant", "tool", "tool", "user", None]), rnd.choice([None, 0, 0, 1, 2])) for c in range(40) for t in rnd.sample(range(100), rnd.randint(1, 30))]
    rows += [(99, t, rnd.choice(["assistant", "tool"]), rnd.choice([0, 1, 2])) for t in range(3000)]  # one conversation over many ranges
    table = spark.createDataFrame(rows, "conversation int, turn int, role string, calls int").repartition(7)
    want, waiting = {}, {}
    for c, t, role, n in sorted(rows, key=lambda r: r[:2]):
        queue = waiting.setdefault(c, deque())
        if role == "assistant":
            queue.extend((t, i) for i in range(n or 0))
        want[c, t] = queue.popleft() if role == "tool" and queue else None
    ids = {}
    found = calls.with_call_ids(table).collect()
    for r in found:
        if r["role"] == "assistant":
            ids |= {(r["conversation"], r["turn"], i): x for i, x in enumerate(r["ids"])}
    assert len(found) == len(rows) and len(set(ids.values())) == sum(n or 0 for _, _, role, n in rows if role == "assistant")
    for r in found:
        if r["role"] != "assistant":
            from_queue = want[r["conversation"], r["turn"]]
            assert r["ids"] == ([ids[(r["conversation"], *from_queue)]] if from_queue else [])


# ---- the greedy rule ----


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_scan(spark, seed):
    rnd = random.Random(seed)
    names = [f"t{i:03}" for i in range(80)]
    parents = {n: rnd.choice(["p", "q", "r", None]) for n in names}
    order = dict(zip(rnd.sample(names, 80), range(80))) if seed < 3 else dict(zip(names, range(80)))
    edges = []
    for i, n in enumerate(names):
        others = rnd.sample([m for m in names if m != n], 3) if seed < 3 else [names[(i + 1) % 80]]
        edges += [(n, "synthetic", m, "synthetic", rnd.choice([0.5, 0.8, 0.9, 0.95]), rank + 1) for rank, m in enumerate(others)]
    marked: set = set()
    for n in sorted(names, key=order.get):
        fits = [e[2] for e in edges if e[0] == n and e[4] > curation.CROSS_PARENT and parents[n] and parents[e[2]] and parents[n] != parents[e[2]]]
        if n not in marked and fits:
            marked |= {n, fits[0]}
    synthetic = spark.createDataFrame([(n, parents[n], order[n]) for n in names], "tool_name string, parent string, ord int")
    table = spark.createDataFrame(edges, "tool_name string, tool_type string, neighbor_name string, neighbor_type string, raw double, rank int")
    assert {r[0] for r in curation.crossing_greedy(synthetic, table).collect()} == marked
    assert curation.crossing_greedy(synthetic, table.where("raw > 2")).count() == 0
