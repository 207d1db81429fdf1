"""Queries of retrieval, schema checks, call graphs and dialogues over the driver's tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import schemas
from tallgrass.operators import call_checks, calls, dag, dialogue, evaluation, records, relational, retrieval, vectors
from tallgrass.streaming import sessions

def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("request"), "turn", "role", F.col("text").alias("content"))


def last_user_query(spark, d):
    return retrieval.last_user_query(_messages(spark, d))


def context_query(spark, d):
    return retrieval.context_query(_messages(spark, d))


def context_query_tail(spark, d):
    return retrieval.context_query(_messages(spark, d), keep="tail")


def instruct_query(spark, d):
    return retrieval.instructed(retrieval.last_user_query(_messages(spark, d)))


def _candidates(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = vectors.nearest(rows.where("id % 100 = 0"), rows, 10, same=True)
    return found.select(F.col("query").alias("request"), F.col("item").alias("name"), "rank")


def rerank_sanitize(spark, d):
    """Replies of a reranker with bad, repeated and missing numbers, over ten candidates each."""
    found = _candidates(spark, d)
    n = F.col("request")
    reply = (
        F.when(n % 500 == 0, F.lit("[3, 1, 3, 12, -1, 0]"))
        .when(n % 500 == 100, F.lit("I choose [9,8,7,6,5,4] for it"))
        .when(n % 500 == 200, F.lit("none"))
        .when(n % 500 == 300, F.lit("[]"))
        .otherwise(F.lit("[2]"))
    )
    orders = found.select("request").distinct().withColumn("reply", reply)
    return retrieval.reranked(found, orders).withColumn("rank", F.col("rank").cast("long"))


def _part_tools(spark, d):
    """Parts as tool definitions, some with sloppy types, without a name or without parameters."""
    parts = _t(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "float").when(F.col("p_size") % 3 == 1, "int").otherwise("string")
    text = F.concat(
        F.lit('{"type": "'), F.when(F.col("p_partkey") % 11 == 0, "tool").otherwise("function"), F.lit('", "function": {'),
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit('"name": "'), "p_name", F.lit('", '))),
        F.lit('"description": "d"'),
        F.when(F.col("p_partkey") % 13 == 0, "").otherwise(
            F.concat(F.lit(', "parameters": {"type": "object", "properties": {"size": {"type": "'), kind, F.lit('"}}}'))
        ),
        F.lit("}}"),
    )
    return parts.select("p_partkey", text.alias("json"))


def schema_fix(spark, d):
    fixed = _part_tools(spark, d).withColumn("json", schemas.fixed_column(F.col("json")))
    return fixed.select("p_partkey", F.get_json_object("json", "$.function.parameters.properties.size.type").alias("type"))


def schema_validate(spark, d):
    tools = _part_tools(spark, d)
    return tools.select("p_partkey", F.array_join(schemas.definition_errors_column(F.col("json")), "; ").alias("errors"))


def arg_check_flat(spark, d):
    """The events' props under a flat schema, in built-in functions."""
    events = _t(spark, d, "events")
    found = schemas.flat_errors(F.col("props"), ["k"], {"k": "integer"}, {"k": [str(i) for i in range(50)]})
    return events.select("event_id", found.alias("result"))


def _nested_tools(spark, d):
    """Parts as tools of two nested objects: enums, items of one of two types, names that may be free."""
    items = F.when(F.col("p_size") % 2 == 0, "integer").otherwise("string")
    kinds = F.when(F.col("p_partkey") % 5 == 0, F.lit('"view", "click"')).otherwise(F.lit('"view", "click", "error", "signup", "purchase"'))
    free = F.when(F.col("p_size") % 3 == 0, "true").otherwise("false")
    text = F.concat(
        F.lit('{"type": "object", "properties": {"meta": {"type": "object", "properties": {"kind": {"type": "string", "enum": ['), kinds,
        F.lit(']}, "tags": {"type": "array", "items": {"type": "'), items, F.lit('"}}}, "required": ["kind"], "additionalProperties": '), free,
        F.lit('}, "inner": {"type": "object", "properties": {"k": {"type": "integer", "enum": [1, 2, 3]}}}}, "required": ["meta", "inner"]}'),
    )
    return _t(spark, d, "part").select(F.concat(F.lit("t"), "p_partkey").alias("tool"), text.alias("parameters"))


def arg_check_nested(spark, d):
    """Events as calls of the parts' tools, with nested arguments."""
    note = F.when(F.col("event_id") % 4 == 0, ', "note": 1').otherwise("")
    meta = F.concat(F.lit('"meta": {"kind": "'), "event_type", F.lit('", "tags": ['), "user_id", F.lit("]"), note, F.lit("}, "))
    text = F.concat(F.lit("{"), F.when(F.col("event_id") % 50 == 0, "").otherwise(meta), F.lit('"inner": '), "props", F.lit("}"))
    events = _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("event_id") % 200).alias("tool"), text.alias("predicted"), F.lit(None).cast("string").alias("gold")
    )
    return call_checks.call_errors(events, _nested_tools(spark, d)).select("id", "result")


def answer_compare(spark, d):
    """Events' arguments against gold ones that differ in a value, a length, a spelling, a type or a name."""
    n = F.col("event_id") % 7

    def text(kind, user, k, more=""):
        return F.concat(F.lit('{"inner": {"k": '), k, F.lit('}, "meta": {'), kind, F.lit(', "tags": ['), user, F.lit("]}"), F.lit(more), F.lit("}"))

    k = F.get_json_object("props", "$.k").cast("long")
    kind = lambda c: F.concat(F.lit('"kind": "'), c, F.lit('"'))
    own = F.col("event_type")
    gold_kind = F.when(n == 3, kind(F.concat(F.lit(" "), F.upper(own), F.lit(" ")))).when(n == 4, kind(F.lit("zzzz"))).when(n == 6, F.lit('"other": 1')).otherwise(kind(own))
    user = F.col("user_id").cast("string")
    gold_user = F.when(n == 2, F.concat(user, F.lit(", 0"))).when(n == 5, F.concat(user, F.lit(".0"))).otherwise(user)
    events = _t(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.lit("any").alias("tool"),
        text(kind(own), user, k.cast("string")).alias("predicted"),
        text(gold_kind, gold_user, F.when(n == 1, k + 1).otherwise(k).cast("string")).alias("gold"),
    )
    tools = _t(spark, d, "part").where("p_partkey = 0").select(
        F.lit("any").alias("tool"),
        F.lit('{"properties": {"inner": {"type": "object", "additionalProperties": true}, "meta": {"type": "object", "additionalProperties": true}}}').alias("parameters"),
    )
    return call_checks.call_errors(events, tools).select("id", "result")


def str_similarity(spark, d):
    parts = _t(spark, d, "part")
    return parts.select("p_partkey", F.round(schemas.ratio_column(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


def plan_rules(spark, d):
    """Line items as planners' actions: a tool for each return flag, arguments from the row."""
    rows = relational.settled(_t(spark, d, "lineitem").withColumn("id", F.monotonically_increasing_id()))  # line items repeat their keys
    tools = spark.createDataFrame([("A", ["quantity", "tax"], ["quantity"]), ("N", ["quantity"], ["quantity"])], "name string, properties array<string>, required array<string>")
    arguments = F.create_map(F.lit("quantity"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("string")).otherwise(F.lit("")))
    more = F.map_concat(arguments, F.create_map(F.lit("tax"), F.col("l_tax").cast("string")))
    action = F.struct(F.col("l_returnflag").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, more).otherwise(arguments).alias("arguments"))
    thought = F.when(F.col("l_linestatus") == "O", "by simulated execution").otherwise("plain")
    found = dialogue.plan_errors(thought, F.lit(""), F.array(action), F.lit(False), tools, rows)
    return found.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def tool_rules(spark, d):
    """Whether parts have as many words in their name as in their type, as actions and observations; some can't be parsed."""
    words = lambda c: F.split(c, " ")
    observations = F.when(F.col("p_partkey") % 9 != 0, F.concat(words("p_type"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("more"))).otherwise(F.array())))
    return _t(spark, d, "part").select("p_partkey", dialogue.observations_match(words("p_name"), observations).alias("matches"))


def _nodes(spark, d):
    """Turns of a conversation as calls: each depends on the turns at half and a third of its number."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("task"), F.col("turn").cast("int").alias("node"), "role")
    half, third = F.floor(F.col("node") / 2).cast("int"), F.floor(F.col("node") / 3).cast("int")
    return turns.withColumn("deps", F.filter(F.array_distinct(F.array(half, third)), lambda x: x < F.col("node")))


def dag_indegree(spark, d):
    return dag.in_degrees(_nodes(spark, d))


def dag_levels(spark, d):
    rows = _nodes(spark, d).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("node", "deps"))).alias("x"))
    found = rows.select("task", F.posexplode(dag.levels_column(F.transform("x", lambda n: n["deps"]))).alias("node", "level"))
    return found.select("task", F.col("node").cast("long").alias("node"), F.col("level").cast("long").alias("level"))


def _named_graphs(spark, d):
    """task, nodes: conversations as graphs whose turns have names of their own."""
    rows = _nodes(spark, d).select("task", F.struct("node", F.concat(F.lit("turn "), "node").alias("name"), "deps").alias("x"))
    graphs = rows.groupBy("task").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a conversation's turns
    return graphs.select("task", F.transform("x", lambda n: F.struct(n["name"].alias("name"), n["deps"].alias("deps"))).alias("nodes"))


def dag_paths(spark, d):
    """All executions of the conversations' graphs."""
    graphs = relational.settled(_named_graphs(spark, d))
    found = graphs.select("task", dag.paths_column(F.col("nodes"))["paths"].alias("paths"))
    return found.select("task", F.explode("paths").alias("path")).select("task", F.to_json("path").alias("path"))


def step_match(spark, d):
    """Conversations as graphs of calls, with predicted steps.

    By conv_id modulo 4: the turns one by one under names of their own; the levels under the roles' names; the turns
    from the last on; the levels, with a strange call in one of them.
    """
    kind = F.col("task") % 4
    rows = dag_levels(spark, d).join(_nodes(spark, d).withColumnRenamed("task", "t").withColumnRenamed("node", "n"), (F.col("task") == F.col("t")) & (F.col("node") == F.col("n")))
    name = F.when(kind % 2 == 0, F.concat(F.lit("turn "), "node")).otherwise(F.col("role"))
    rows = rows.select("task", F.struct("node", name.alias("name"), "deps", "level").alias("x"))
    graphs = rows.groupBy("task").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a conversation's turns
    last = F.array_max(F.transform("x", lambda n: n["level"]))
    levels = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.transform(F.filter("x", lambda n: n["level"] == i), lambda n: n["name"]))
    singles = F.transform("x", lambda n: F.array(n["name"]))
    strange = F.floor(F.col("task") / 4) % (last + 1)
    told = (
        F.when(kind == 0, singles)
        .when(kind == 1, levels)
        .when(kind == 2, F.reverse(singles))
        .otherwise(F.transform(levels, lambda names, i: F.when(i == strange, F.array_append(F.slice(names, 2, 100), F.lit("strange"))).otherwise(names)))
    )
    nodes = F.transform("x", lambda n: F.struct(n["name"].alias("name"), n["deps"].alias("deps")))
    logs = relational.settled(graphs.select("task", nodes.alias("nodes"), told.alias("told")))
    found = logs.select("task", dag.replay_column(F.col("nodes"), F.col("told")).alias("r"))
    as_long = lambda c: F.col(f"r.{c}").cast("long").alias(c)
    return found.select("task", "r.label", as_long("step"), as_long("failed_at"), "r.is_optimal")


def _log(spark, d):
    """Events as steps, six to a task, with two calls each; some steps have a wrong name, some are control actions."""
    bad, control = (F.col("event_id") * 7919) % 23 == 0, F.col("event_type") == "signup"
    return _t(spark, d, "events").select(
        F.floor(F.col("event_id") / 6).alias("task"),
        (F.col("event_id") % 6).alias("step"),
        F.when(bad, "error").otherwise("correct").alias("name_label"),
        control.alias("control"),
        "event_id", "event_type", "user_id", "props",
    )


def params_label(spark, d):
    """Labels of tasks from the events' log: calls paired and checked, steps walked."""
    log = _log(spark, d)
    looked = log.where("name_label = 'correct' AND NOT control")
    wrong = F.when(F.col("event_id") % 13 == 0, F.lit("77")).otherwise(F.col("user_id").cast("string"))
    predicted = F.array(
        F.struct(F.lit("log").alias("name"), F.concat(F.lit('{"user": '), wrong, F.lit("}")).alias("arguments")),
        F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")),
    )
    gold = F.array(
        F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")),
        F.struct(F.lit("log").alias("name"), F.concat(F.lit('{"user": '), F.col("user_id"), F.lit("}")).alias("arguments")),
    )
    schema = lambda name, kind, more: F.lit(f'{{"type": "object", "properties": {{"{name}": {{"type": "{kind}"{more}}}}}, "required": ["{name}"]}}')
    tools = _t(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    tools = tools.select("name", F.when(F.col("name") == "click", schema("k", "integer", f', "enum": {list(range(95))}')).otherwise(schema("k", "integer", "")).alias("parameters"))
    tools = tools.unionByName(tools.limit(1).select(F.lit("log").alias("name"), schema("user", "integer", "").alias("parameters")))
    pairs = evaluation.checked_pairs(looked.select("task", "step", F.inline(predicted)), looked.select("task", "step", F.inline(gold)), tools, ["task", "step"])
    tasks = log.groupBy("task").agg(F.when(F.bool_or(F.col("name_label") == "error"), "error").otherwise("correct").alias("name_label"))
    tasks = tasks.withColumn("is_optimal", F.col("task") % 2 == 0)
    return evaluation.task_labels(tasks, evaluation.step_labels(log, pairs))


def _tasks(spark, d):
    """Conversations as tasks, four to a dialogue: their turns are answers under names of their own, and one answer ends them."""
    turns = _nodes(spark, d).join(_t(spark, d, "conversations").select("conv_id", "turn", "text"), (F.col("task") == F.col("conv_id")) & (F.col("node") == F.col("turn")))
    name = F.when((F.col("node") == 0) & (F.col("role") == "system"), dag.ASK).otherwise(F.concat(F.lit("turn "), "node"))
    observation = F.concat(F.lit("seen "), F.substring("text", 1, 20))
    user = F.when(F.col("node") == 0, "as you like")
    arguments = F.concat(F.lit('{"turn": '), "node", F.lit("}"))
    one = F.struct("node", F.struct(name.alias("name"), arguments.alias("arguments"), observation.alias("observation"), user.alias("user_input"), "deps").alias("a"))
    whole = turns.groupBy("task").agg(F.array_sort(F.collect_list(one)).alias("x"), F.min_by("text", "node").alias("text"))  # a conversation's turns
    answers = F.transform("x", lambda n: n["a"])
    final = F.struct(
        F.lit(dag.ANSWER).alias("name"), F.lit("{}").alias("arguments"), F.lit("done").alias("observation"),
        F.lit(None).cast("string").alias("user_input"), F.transform("x", lambda n: n["node"].cast("int")).alias("deps"),
    )
    return whole.select(
        F.floor(F.col("task") / 4).alias("dialogue"), "task", F.concat(F.lit("day "), "task").alias("env"),
        F.substring("text", 1, 30).alias("text"), F.concat(answers, F.array(final)).alias("answers"),
    )


def history_messages(spark, d):
    found = evaluation.history(_tasks(spark, d))
    return found.select("dialogue", "number", "task", "role", "content", F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("calls"))


def task_paths(spark, d):
    """A path of task types for each turn of a conversation: that of its number among all of up to four tasks."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn")
    return turns.select("conv_id", "turn", F.array_join(dialogue.path_at(F.col("conv_id") * 8 + F.col("turn"), 4), ">").alias("path"))


def illegal_turns(spark, d):
    """The first turn of each conversation that the state machine doesn't allow, with speakers by turn and role."""
    turn = F.col("turn")
    name = (
        F.when(turn % 7 == 5, "Switch")
        .when(F.col("role") == "user", F.when(turn % 4 == 2, "Tool").otherwise("User"))
        .when(F.col("role") == "assistant", F.when(turn % 4 == 3, "Agent").when((F.col("conv_id") + turn) % 5 == 0, "Checker").otherwise("Planner"))
    )
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(name, F.lit(": "), "text").alias("content"))
    return dialogue.first_illegal(rows, "conv_id", "turn")


def transcript_clean(spark, d):
    """Conversations as transcripts: by turn, users, planners, refusing and agreeing checkers, and switches."""
    turns = _t(spark, d, "conversations")
    fence = lambda word: F.concat(F.lit('Checker_Planner: ```json\n{"correct": "'), F.lit(word), F.lit('"}\n```'))
    content = (
        F.when(F.col("turn") % 5 == 1, F.concat(F.lit("Planner: "), "text"))
        .when(F.col("turn") % 5 == 2, F.lit("Switch to checker"))
        .when(F.col("turn") % 5 == 3, F.when(F.col("conv_id") % 2 == 0, fence("no")).otherwise(fence("yes")))
        .otherwise(F.concat(F.lit("User: "), "text"))
    )
    rows = turns.select("conv_id", F.struct("turn", content.alias("content")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    kept = dialogue.cleaned(F.col("m"))
    return whole.select("conv_id", F.array_join(F.transform(kept, lambda m: m["turn"].cast("string")), ",").alias("turns"))


def call_forms(spark, d):
    """Each event as one call in each form."""
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("struct<name:string,arguments:string>")
    simple = F.struct(text.alias("id"), F.col("event_type").alias("name"), F.col("props").alias("arguments"), none.alias("function"))
    function = F.struct(F.lit("log").alias("name"), F.lit("[]").alias("arguments")).alias("function")
    whole = F.struct(F.concat(F.lit("c"), F.col("event_id")).alias("id"), text.alias("name"), text.alias("arguments"), function)
    bare = F.struct(text.alias("id"), F.lit("noop").alias("name"), text.alias("arguments"), none.alias("function"))
    found = calls.normalised(F.array(simple, whole, bare))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.posexplode(found).alias("place", "call"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), "call.id", "call.function.name", "call.function.arguments")


def call_pairs(spark, d):
    """Line items as calls: those of odd numbers as predicted beside all as gold ones, with whether they are equal."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    text = lambda c: F.concat(F.col(c), F.lit(":"), F.col("l_linenumber"))
    gold = items.select("l_orderkey", F.col("l_returnflag").alias("name"), text("l_linestatus").alias("arguments"))
    predicted = items.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_returnflag").alias("name"), text("l_linestatus").alias("arguments"))
    found = calls.paired(predicted, gold, ["l_orderkey"])
    same = F.col("predicted").eqNullSafe(F.col("gold"))
    return found.select("l_orderkey", "place", F.col("predicted.name").alias("predicted"), F.col("gold.name").alias("gold"), same.alias("same"))


def message_ids(spark, d):
    """Turns as messages: the assistant's make none to two calls, the user's answer one."""
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", role, (F.col("turn") % 3).alias("calls"))
    found = calls.with_call_ids(rows, "conv_id", "turn")
    return found.select("conv_id", "turn", "role", F.array_join("ids", ",").alias("ids"))


def param_split(spark, d):
    """The words of a part's name, by whether its type has them, or they are long."""
    names = F.split("p_name", " ")
    needed = F.concat(F.split(F.lower("p_type"), " "), F.filter(names, lambda x: F.length(x) > 5))
    found = calls.split_parameters(names, needed)
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", found.alias("x"))
    return rows.select("p_partkey", F.array_join("x.required", ",").alias("required"), F.array_join("x.optional", ",").alias("optional"))


def session_turns(spark, d):
    """Conversations as sessions of two questions at most, which a word ends."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", F.col("text").alias("content"))
    return sessions.batch_sessions(turns, 2, "ble.").select("conversation", "turn", "role", "questions", "ends")


def _records(spark, d):
    """Events as benchmark records: lists of tools and tasks under both names; some prefixed lists are empty, some absent."""
    n = F.col("event_id")
    tool = lambda k: F.concat(F.lit('{"function": {"name": "t'), (n * k) % 40, F.lit('"}}'))
    english = F.when(n % 3 == 0, F.concat(F.lit('"english_tools": ['), tool(1), F.lit(", "), tool(7), F.lit('], "english_tasks": [" plain ", {"input": "inner '), "event_type", F.lit('"}], ')))
    english = english.when(n % 3 == 1, F.lit('"english_tools": [], "english_tasks": [], ')).otherwise("")
    json = F.concat(F.lit("{"), english, F.lit('"tools": ["t'), n % 60, F.lit('", {"name": "t'), n % 7, F.lit('"}], "tasks": [{"x": '), n % 5, F.lit("}]}"))
    return _t(spark, d, "events").select(n.alias("id"), json.alias("json"))


def _catalog(spark, d):
    return _t(spark, d, "part").where("p_partkey < 50").select(F.concat(F.lit("t"), "p_partkey").alias("name"))


def _task_counts(found):
    return found.groupBy("name", "text").agg(F.count(F.lit(1)).alias("n"), F.min("ord.id").alias("first"))


def catalog_tasks(spark, d):
    """Tasks of the catalog's tools, from records whose prefixed lists count if they have elements."""
    return _task_counts(records.catalog_tasks(_records(spark, d), _catalog(spark, d)))


def catalog_tasks_present(spark, d):
    """The same, where prefixed lists count if they are there at all, and texts stay as they are."""
    return _task_counts(records.catalog_tasks(_records(spark, d), _catalog(spark, d), by="present", strip=False))


def tool_info(spark, d):
    """What the parts' tools take, as a sentence."""
    words = F.split("p_name", " ")
    properties = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('": {}'))), ", ")
    json = F.concat(F.lit('{"function": {"parameters": {"properties": {'), properties, F.lit('}, "required": ["'), words[0], F.lit('"]}}}'))
    tools = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), json.alias("json"))
    return records.told_info(records.tool_info(tools))


def generated_tools(spark, d):
    """Replies made of the parts' rows: a comment, a fence, a definition with a reason, one without a name, no JSON."""
    line = F.concat(F.lit('{"function": {"name": "'), "p_name", F.lit('"}, "reason": "none"'), F.when(F.col("p_size") % 2 == 0, ', "type": "tool"').otherwise(""), F.lit("}"))
    reply = F.concat_ws("\n", F.lit("# tools"), F.lit("```json"), line, F.lit('{"function": {}}'), F.lit("  "), F.lit("that is all"), F.lit("```"))
    made = F.explode(records.generated_tools(reply)).alias("json")
    rows = _t(spark, d, "part").select("p_partkey", made)
    return rows.select("p_partkey", F.get_json_object("json", "$.type").alias("type"), F.get_json_object("json", "$.function.name").alias("name"), F.array_join(F.array_sort(F.json_object_keys("json")), ",").alias("fields"))


QUERIES = {
    f.__name__: f
    for f in (
        last_user_query, context_query, context_query_tail, instruct_query, rerank_sanitize, schema_fix, schema_validate, arg_check_flat,
        arg_check_nested, answer_compare, str_similarity, plan_rules, tool_rules, dag_indegree, dag_levels, dag_paths, step_match,
        params_label, task_paths, transcript_clean, call_forms, call_pairs, message_ids, param_split, history_messages, illegal_turns, session_turns,
        catalog_tasks, catalog_tasks_present, tool_info, generated_tools,
    )
}

_LAST = """WITH u AS (SELECT conv_id, left(arg_max(text, turn), 500) AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations),
q AS (SELECT c.conv_id AS request, coalesce(query, '') AS query FROM c LEFT JOIN u USING (conv_id))
"""
_CONTEXT = """WITH x AS (SELECT conv_id AS request, string_agg('[' || upper(role) || ']: ' || text, chr(10) ORDER BY turn)
FILTER (trim(text) <> '') AS t FROM conversations GROUP BY 1)
"""

SQL = {
    "catalog_tasks": """WITH r AS (SELECT event_id AS id, event_id % 3 = 0 AS english, event_id % 3 <> 0 AS plain, event_type FROM events),
t AS (SELECT id, 't' || (id * k) % 40 AS name FROM r, (SELECT unnest([1, 7]) AS k) WHERE english
  UNION ALL SELECT id, 't' || id % k FROM r, (SELECT unnest([60, 7]) AS k) WHERE plain),
x AS (SELECT id, 'plain' AS text FROM r WHERE english UNION ALL SELECT id, 'inner ' || event_type FROM r WHERE english
  UNION ALL SELECT id, '{"x":' || id % 5 || '}' FROM r WHERE plain)
SELECT name, text, count(*) AS n, min(id) AS first FROM t JOIN x USING (id) WHERE name IN (SELECT 't' || p_partkey FROM part WHERE p_partkey < 50) GROUP BY 1, 2""",
    "catalog_tasks_present": """WITH r AS (SELECT event_id AS id, event_id % 3 = 0 AS english, event_id % 3 = 2 AS plain, event_type FROM events),
t AS (SELECT id, 't' || (id * k) % 40 AS name FROM r, (SELECT unnest([1, 7]) AS k) WHERE english
  UNION ALL SELECT id, 't' || id % k FROM r, (SELECT unnest([60, 7]) AS k) WHERE plain),
x AS (SELECT id, ' plain ' AS text FROM r WHERE english UNION ALL SELECT id, 'inner ' || event_type FROM r WHERE english
  UNION ALL SELECT id, '{"x":' || id % 5 || '}' FROM r WHERE plain)
SELECT name, text, count(*) AS n, min(id) AS first FROM t JOIN x USING (id) WHERE name IN (SELECT 't' || p_partkey FROM part WHERE p_partkey < 50) GROUP BY 1, 2""",
    "tool_info": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS name, 'Tool ' || p_partkey || ' needs [' || w[1] || '] and may be given [' || array_to_string(w[2:], ', ') || '].' AS told FROM w""",
    "generated_tools": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'tool' ELSE 'function' END AS type, p_name AS name, 'function,type' AS fields FROM part""",
    "session_turns": """WITH RECURSIVE w AS (SELECT conv_id, -1::BIGINT AS turn, NULL::VARCHAR AS role, 0 AS questions, false AS ends FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT c.conv_id, c.turn, c.role, questions + CAST(c.role = 'user' AS INT), c.text LIKE '%ble.%' OR (c.role = 'assistant' AND questions = 2)
  FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE NOT ends AND questions + CAST(c.role = 'user' AS INT) <= 2)
SELECT conv_id AS conversation, turn, role, CAST(questions AS BIGINT) AS questions, ends FROM w WHERE turn >= 0""",
    "last_user_query": _LAST + "SELECT request, query FROM q",
    "context_query": _CONTEXT + "SELECT request, coalesce(left(t, 2000), '') AS query FROM x",
    "context_query_tail": _CONTEXT + "SELECT request, coalesce(right(t, 2000), '') AS query FROM x",
    "instruct_query": _LAST + f"SELECT request, 'Instruct: {retrieval.INSTRUCTION}' || chr(10) || 'Query: ' || query AS query FROM q",
    "rerank_sanitize": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT a.vec_id AS request, b.vec_id AS name, list_cosine_similarity(a.e, b.e) AS raw FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
c AS (SELECT request, name, row_number() OVER (PARTITION BY request ORDER BY raw DESC, name) - 1 AS place FROM x QUALIFY place < 10),
o AS (SELECT 0 AS k, 3 AS place, 1 AS rank UNION ALL SELECT 0, 1, 2 UNION ALL SELECT 0, 0, 3
  UNION ALL SELECT 100, 9 - i, i + 1 FROM range(5) t(i) UNION ALL SELECT 200, i, i + 1 FROM range(5) t(i) UNION ALL SELECT 400, 2, 1)
SELECT request, name, CAST(rank AS BIGINT) AS rank FROM c JOIN o ON request % 500 = k AND c.place = o.place""",
    "schema_fix": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN (['float', 'int', 'string'])[p_size % 3 + 1]
ELSE (['number', 'integer', 'string'])[p_size % 3 + 1] END AS type FROM part""",
    "schema_validate": """SELECT p_partkey, array_to_string(list_filter([
CASE WHEN p_partkey % 11 = 0 THEN 'Invalid type: tool (expected ''function'')' END,
CASE WHEN p_partkey % 7 = 0 THEN 'Missing function name' END,
CASE WHEN p_partkey % 13 = 0 THEN 'Missing function parameters'
     WHEN p_size % 3 = 0 THEN 'Invalid type ''float'' at properties.size (should use: number, integer, boolean, string, array, object)'
     WHEN p_size % 3 = 1 THEN 'Invalid type ''int'' at properties.size (should use: number, integer, boolean, string, array, object)' END
], lambda x: x IS NOT NULL), '; ') AS errors FROM part""",
    "arg_check_flat": f"""SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN '{schemas.ERRORS["missing"][0]}'
WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN '{schemas.ERRORS["enum"][1]}' ELSE 'correct' END AS result FROM events""",
    "plan_rules": """WITH r AS (SELECT array_to_string(list_sort(list_filter([
CASE WHEN l_linestatus = 'O' THEN 'simulation' END,
CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'unknown tool' END,
CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'unknown argument' END,
CASE WHEN l_returnflag IN ('A', 'N') AND l_quantity <= 25 THEN 'empty required' END
], lambda x: x IS NOT NULL)), '; ') AS errors FROM lineitem)
SELECT errors, count(*) AS n FROM r GROUP BY 1""",
    "tool_rules": """SELECT p_partkey, p_partkey % 9 <> 0 AND len(string_split(p_name, ' ')) = len(string_split(p_type, ' ')) + CAST(p_size % 2 = 0 AS INT) AS matches
FROM part""",
    "arg_check_nested": f"""SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN '{schemas.ERRORS["missing"][0]}'
WHEN p_partkey % 5 = 0 AND event_type NOT IN ('view', 'click') THEN '{schemas.ERRORS["enum"][1]}'
WHEN p_size % 2 = 1 THEN '{schemas.ERRORS["type"][1]}'
WHEN event_id % 4 = 0 AND p_size % 3 <> 0 THEN '{schemas.ERRORS["undefined"][1]}'
WHEN CAST(json_extract(props, '$.k') AS INT) NOT IN (1, 2, 3) THEN '{schemas.ERRORS["enum"][1]}'
ELSE 'correct' END AS result FROM events JOIN part ON p_partkey = event_id % 200""",
    "answer_compare": f"""SELECT event_id AS id, CASE event_id % 7 WHEN 1 THEN '{schemas.VALUE} at ''inner.k''' WHEN 2 THEN '{schemas.LENGTH} at ''meta.tags'''
WHEN 4 THEN '{schemas.SIMILARITY} at ''meta.kind'' (edit score: 0.00)' WHEN 5 THEN '{schemas.TYPE} at ''meta.tags[0]'''
WHEN 6 THEN '{schemas.KEYS} at ''meta'' (missing: [''other''], extra: [''kind''])' ELSE 'correct' END AS result FROM events""",
    "step_match": """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn, unnest([turn // 2, turn // 3]) AS dep FROM conversations),
l AS (SELECT conv_id, turn, 0 AS level FROM conversations WHERE turn = 0
  UNION SELECT e.conv_id, e.turn, l.level + 1 FROM e JOIN l ON e.conv_id = l.conv_id AND e.dep = l.turn AND e.dep < e.turn),
s AS (SELECT conv_id AS task, conv_id % 4 AS kind, max(turn) AS last, max(level) AS top FROM l GROUP BY 1, 2),
x AS (SELECT *, (task // 4) % (top + 1) AS strange, kind = 3 OR (kind = 2 AND last > 0) AS bad FROM s)
SELECT task, CASE WHEN bad THEN 'error' ELSE 'correct' END AS label,
CAST(CASE kind WHEN 0 THEN last WHEN 1 THEN top WHEN 2 THEN 0 ELSE strange END AS BIGINT) AS step,
CAST(CASE WHEN bad THEN CASE kind WHEN 2 THEN 0 ELSE strange END END AS BIGINT) AS failed_at,
NOT bad AND (kind <> 0 OR last = top) AS is_optimal FROM x""",
    "params_label": """WITH RECURSIVE s AS (SELECT event_id // 6 AS task, event_id % 6 AS step, (event_id * 7919) % 23 = 0 AS bad,
  event_type <> 'signup' AND ((event_id % 13 = 0 AND user_id <> 77) OR (event_type = 'click' AND CAST(json_extract(props, '$.k') AS INT) > 94)) AS wrong FROM events),
t AS (SELECT task, CASE WHEN bool_or(bad) THEN 'error' ELSE 'correct' END AS name, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT task, -1::BIGINT AS step, 'correct' AS args, name, n, NULL::BIGINT AS struck, false AS ended FROM t
  UNION ALL SELECT w.task, s.step, CASE WHEN w.args = 'error' OR s.bad THEN w.args WHEN s.wrong THEN 'error' ELSE w.args END,
    CASE WHEN w.args = 'error' THEN 'correct' ELSE w.name END, n, CASE WHEN w.args = 'error' THEN s.step END, w.args = 'error' OR s.bad
  FROM w JOIN s ON s.task = w.task AND s.step = w.step + 1 WHERE NOT w.ended),
z AS (SELECT *, CASE WHEN name = 'correct' THEN args END AS arguments_label FROM w QUALIFY row_number() OVER (PARTITION BY task ORDER BY step DESC) = 1)
SELECT task, name AS name_label, arguments_label, task % 2 = 0 AND NOT (name = 'correct' AND args = 'error') AS is_optimal,
n - CAST(struck IS NOT NULL AS BIGINT) AS steps, struck,
CASE WHEN name = 'correct' AND arguments_label = 'correct' THEN 'correct' ELSE 'error' END AS label FROM z""",
    "history_messages": f"""WITH RECURSIVE n AS (SELECT conv_id AS task, turn, role, text FROM conversations),
e AS (SELECT DISTINCT task, turn AS child, unnest([turn // 2, turn // 3]) AS dep FROM n),
h AS (SELECT task, turn, 2 AS height FROM n UNION SELECT h.task, e.dep, h.height + 1 FROM h JOIN e ON e.task = h.task AND e.child = h.turn AND e.dep < e.child),
g AS (SELECT task, turn, max(height) AS height FROM h GROUP BY 1, 2),
p AS (SELECT *, max(height) OVER (PARTITION BY task) - height AS step, role = 'system' AND turn = 0 AS asks FROM g JOIN n USING (task, turn)),
m AS (
  SELECT task // 4 AS dialogue, min(task) AS task, -1 AS step, 0 AS kind, 0::BIGINT AS turn, 'system' AS role, 'Current Date: day ' || min(task) AS content, '' AS calls FROM n GROUP BY 1
  UNION ALL SELECT task // 4, task, -1, 1, 0, 'user', left(text, 30), '' FROM n WHERE turn = 0
  UNION ALL SELECT task // 4, task, step, 0, 0, 'assistant', CASE WHEN bool_or(asks) THEN min('seen ' || left(text, 20)) ELSE '' END,
    CASE WHEN bool_or(asks) THEN '' ELSE string_agg('turn ' || turn, ',' ORDER BY turn) END FROM p GROUP BY task, step
  UNION ALL SELECT task // 4, task, step, 1, turn, CASE WHEN asks THEN 'user' ELSE 'tool' END, CASE WHEN asks THEN 'as you like' ELSE 'seen ' || left(text, 20) END, '' FROM p
  UNION ALL SELECT task // 4, task, 1000, 0, 0, 'assistant', 'done', '' FROM n WHERE turn = 0)
SELECT dialogue, row_number() OVER (PARTITION BY dialogue ORDER BY task, step, kind, turn) - 1 AS number, task, role, content, calls FROM m""",
    "dag_indegree": """SELECT conv_id AS task, CAST(turn AS INT) AS node,
CAST(len(list_distinct(list_filter([turn // 2, turn // 3], lambda x: x < turn))) AS BIGINT) AS degree FROM conversations""",
    "dag_levels": """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn, unnest([turn // 2, turn // 3]) AS dep FROM conversations),
l AS (SELECT conv_id, turn, 0 AS level FROM conversations WHERE turn = 0
  UNION SELECT e.conv_id, e.turn, l.level + 1 FROM e JOIN l ON e.conv_id = l.conv_id AND e.dep = l.turn AND e.dep < e.turn)
SELECT conv_id AS task, CAST(turn AS BIGINT) AS node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY 1, 2""",
    "task_paths": """WITH t AS (SELECT unnest(['ST', 'MT', 'CQ', 'CC']) AS x, unnest(range(4)) AS i),
p AS (SELECT i AS n, x AS path FROM t UNION ALL SELECT 4 + 4 * a.i + b.i, a.x || '>' || b.x FROM t a, t b
UNION ALL SELECT 20 + 16 * a.i + 4 * b.i + c.i, a.x || '>' || b.x || '>' || c.x FROM t a, t b, t c
UNION ALL SELECT 84 + 64 * a.i + 16 * b.i + 4 * c.i + d.i, a.x || '>' || b.x || '>' || c.x || '>' || d.x FROM t a, t b, t c, t d)
SELECT conv_id, turn, path FROM conversations JOIN p ON n = (conv_id * 8 + turn) % 340""",
    "illegal_turns": """WITH RECURSIVE s AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN 'Switch' WHEN role = 'user' THEN CASE WHEN turn % 4 = 2 THEN 'Tool' ELSE 'User' END
  WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 3 THEN 'Agent' WHEN (conv_id + turn) % 5 = 0 THEN 'Checker' ELSE 'Planner' END ELSE '' END AS who FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM s WHERE who <> 'Switch'),
ok AS (SELECT unnest(['User', 'Tool', 'Checker', 'Checker', 'Checker', 'Planner', 'Planner', 'Planner', 'Agent']) AS before,
  unnest(['Planner', 'Planner', 'Planner', 'Tool', 'Agent', 'Checker', 'Tool', 'Agent', 'User']) AS after),
w AS (SELECT conv_id, nth, who, NULL::BIGINT AS turn, NULL::VARCHAR AS before FROM r WHERE nth = 1 AND who = 'User'
  UNION ALL SELECT conv_id, nth, who, turn, '' AS before FROM r WHERE nth = 1 AND who <> 'User'
  UNION ALL SELECT r.conv_id, r.nth, r.who, CASE WHEN NOT EXISTS (SELECT 1 FROM ok WHERE ok.before = w.who AND ok.after = r.who) THEN r.turn END, w.who
  FROM w JOIN r ON r.conv_id = w.conv_id AND r.nth = w.nth + 1 WHERE w.turn IS NULL)
SELECT c.conv_id, w.turn, w.before, CASE WHEN w.turn IS NOT NULL THEN w.who END AS speaker
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM w WHERE turn IS NOT NULL) w USING (conv_id)""",
    "dag_paths": """WITH RECURSIVE n AS (SELECT DISTINCT conv_id AS task, CAST(turn AS INT) AS turn,
  (SELECT coalesce(bit_or(1 << CAST(x AS INT)), 0) FROM unnest(list_filter([turn // 2, turn // 3], lambda x: x < turn)) u(x)) AS needs FROM conversations),
m AS (SELECT task, mask, bit_or(needs) AS needs, '[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ']' AS step
  FROM n JOIN (SELECT unnest(range(1, 256)) AS mask) s ON (mask >> turn) & 1 = 1 GROUP BY task, mask
  HAVING count(*) = bit_count(mask)),
t AS (SELECT task, (1 << CAST(count(*) AS INT)) - 1 AS whole FROM n GROUP BY 1),
p AS (SELECT task, 0 AS done, '' AS path FROM t
  UNION ALL SELECT p.task, p.done | m.mask, p.path || CASE WHEN p.path = '' THEN '' ELSE ',' END || m.step
  FROM p JOIN m ON m.task = p.task AND m.mask & p.done = 0 AND m.needs & ~p.done = 0)
SELECT task, '[' || path || ']' AS path FROM p JOIN t USING (task) WHERE done = whole""",
    "transcript_clean": """SELECT conv_id, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (
turn % 5 NOT IN (2, 3) AND NOT (conv_id % 2 = 0 AND turn % 5 = 1 AND turn + 2 <= last)), '') AS turns
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1""",
    "call_forms": f"""SELECT event_id, 0::BIGINT AS place, '{calls.ID_PREFIX}0' AS id, event_type AS name, props AS arguments FROM events
UNION ALL SELECT event_id, 1, 'c' || event_id, 'log', '[]' FROM events
UNION ALL SELECT event_id, 2, '{calls.ID_PREFIX}2', 'noop', '{{}}' FROM events""",
    "call_pairs": """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, l_linestatus || ':' || l_linenumber AS arguments FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY name, arguments) - 1 AS place FROM g WHERE l_linenumber % 2 = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY name, arguments) - 1 AS place FROM g)
SELECT l_orderkey, place, a.name AS predicted, b.name AS gold,
a.name IS NOT DISTINCT FROM b.name AND a.arguments IS NOT DISTINCT FROM b.arguments AS same FROM a FULL JOIN b USING (l_orderkey, place)""",
    "message_ids": f"""WITH RECURSIVE m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role,
  CASE WHEN role = 'assistant' THEN list_transform(range(turn % 3), lambda c: '{calls.ID_PREFIX}' || substr(sha256(conv_id || '|' || turn || '|' || c), 1, {calls.ID_LENGTH})) ELSE [] END AS made,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
q AS (SELECT conv_id, 0::BIGINT AS nth, []::VARCHAR[] AS waiting, NULL::VARCHAR AS taken FROM m WHERE nth = 1
  UNION ALL SELECT m.conv_id, m.nth, CASE WHEN m.role = 'tool' THEN q.waiting[2:] ELSE list_concat(q.waiting, m.made) END, CASE WHEN m.role = 'tool' THEN q.waiting[1] END
  FROM q JOIN m ON m.conv_id = q.conv_id AND m.nth = q.nth + 1)
SELECT conv_id, turn, role, coalesce(taken, array_to_string(made, ',')) AS ids FROM m JOIN q USING (conv_id, nth)""",
    "param_split": """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS names, string_split(lower(p_type), ' ') AS kinds FROM part)
SELECT p_partkey, array_to_string(list_filter(names, lambda x: length(x) > 5 OR list_contains(kinds, x)), ',') AS required,
array_to_string(list_filter(names, lambda x: NOT (length(x) > 5 OR list_contains(kinds, x))), ',') AS optional FROM p""",
}
