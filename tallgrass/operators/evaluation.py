"""Evaluation of logs of tasks: labels of arguments and tasks, and replay of gold answers as messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators import call_checks, calls, dag, relational

CORRECT, ERROR = "correct", "error"


def checked_pairs(predicted: DataFrame, gold: DataFrame, tools: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, place, name, result: the calls of both sides, paired by place within the key, checked by schema and gold arguments.

    predicted and gold: key, name, arguments (JSON text); tools: name, parameters (JSON text).  A pair of different
    names, or a call without partner, breaks what a step of correct names promises, and a gold name without
    definition breaks the catalog: both raise.
    """
    pairs = calls.paired(predicted, gold, key)
    alike = F.col("predicted.name").eqNullSafe(F.col("gold.name"))
    told = F.concat(F.lit("a step of correct names has other calls than the gold one: "), F.to_json(F.struct(*key, "predicted", "gold")))
    name = F.when(alike, F.col("gold.name")).otherwise(F.raise_error(told).cast("string"))
    rows = relational.settled(
        pairs.select(*key, "place", name.alias("tool"), F.col("predicted.arguments").alias("predicted"), F.col("gold.arguments").alias("gold"))
    )
    # equal calls are checked once
    shapes = rows.select("tool", "predicted", "gold").distinct()
    shapes = relational.settled(shapes.withColumn("id", F.monotonically_increasing_id()))
    checked = call_checks.call_errors(shapes, tools.select(F.col("name").alias("tool"), "parameters"))
    results = checked.select(F.col("tool").alias("__tool"), F.col("predicted").alias("__predicted"), F.col("gold").alias("__gold"), "result")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("tool", "predicted", "gold")]
    return rows.join(results, same).select(*key, "place", F.col("tool").alias("name"), "result")


def step_labels(steps: DataFrame, pairs: DataFrame, task: str = "task", step: str = "step") -> DataFrame:
    """task, step, name_label, arguments_label: a step is wrong if one of its pairs is; null where the walk doesn't look.

    steps: task, step, name_label, control (whether the gold step is a control action, which has no arguments to check).
    """
    wrong = pairs.groupBy(task, step).agg(F.bool_or(F.col("result") != CORRECT).alias("__wrong"))
    met = steps.join(wrong, [task, step], "left")
    looked = (F.col("name_label") == CORRECT) & ~F.col("control")
    return met.select(task, step, "name_label", F.when(looked, F.when(F.coalesce("__wrong", F.lit(False)), ERROR).otherwise(CORRECT)).alias("arguments_label"))


def task_labels(tasks: DataFrame, steps: DataFrame, task: str = "task", step: str = "step") -> DataFrame:
    """task, name_label, arguments_label, is_optimal, steps, struck, label from tasks (task, name_label, is_optimal) and `step_labels`.

    A walk along a task's steps as two aggregates.  It ends at the first step with a wrong name.  The first step
    with wrong arguments before that makes the task's arguments wrong; the step after it, if there is one, is struck
    from the log (`struck`), and the name counts as correct whatever came later.  The arguments count only under a
    correct name, and wrong ones undo the mark of optimality.  A task without steps has correct arguments.
    """
    at = F.col(step)
    first = steps.groupBy(task).agg(
        F.count(F.lit(1)).alias("__steps"),
        F.min(F.when(F.col("name_label") == ERROR, at)).alias("__name"),
        F.min(F.when(F.col("arguments_label") == ERROR, at)).alias("__wrong"),
    )
    before = F.col("__name").isNull() | (F.col("__wrong") < F.col("__name"))
    first = first.withColumn("__wrong", F.when(before, F.col("__wrong")))
    later = steps.join(first.where("__wrong IS NOT NULL").select(task, "__wrong"), task).where(at > F.col("__wrong"))
    struck = later.groupBy(task).agg(F.min(step).alias("struck"))
    met = tasks.join(first, task, "left").join(struck, task, "left")
    name = F.when(F.col("struck").isNotNull(), CORRECT).otherwise(F.col("name_label"))
    wrong = F.col("__wrong").isNotNull()
    found = met.select(
        task,
        name.alias("name_label"),
        F.when(name == CORRECT, F.when(wrong, ERROR).otherwise(CORRECT)).alias("arguments_label"),
        (F.col("is_optimal") & ~((name == CORRECT) & wrong)).alias("is_optimal"),
        (F.coalesce("__steps", F.lit(0)) - F.col("struck").isNotNull().cast("int")).cast("long").alias("steps"),
        "struck",
    )
    return found.withColumn("label", F.when((F.col("name_label") == CORRECT) & (F.col("arguments_label") == CORRECT), CORRECT).otherwise(ERROR))


# ---- replay ----

MESSAGE = "struct<role:string,content:string,calls:array<struct<name:string,arguments:string>>>"


def _message(role: str, content: Column, acts: Column | None = None) -> Column:
    own = acts if acts is not None else F.array()
    return F.struct(F.lit(role).alias("role"), content.alias("content"), own.alias("calls")).cast(MESSAGE)


def step_messages(acts: Column, consecutive: bool = True) -> Column:
    """The messages of one step, an array of structs of name, arguments, observation, user_input.

    A question to the user and an answer stand alone in their step, else this raises.  The observations come one
    by one, or, if not `consecutive`, as one message with a JSON array.
    """
    first = acts[0]
    control = F.exists(acts, lambda a: a["name"].isin(dag.ASK, dag.ANSWER))
    asked = F.array(_message("assistant", first["observation"]), _message("user", first["user_input"]))
    made = F.transform(acts, lambda a: F.struct(a["name"].alias("name"), a["arguments"].alias("arguments")))
    seen = F.transform(acts, lambda a: _message("tool", a["observation"]))
    if not consecutive:
        seen = F.array(_message("tool", F.to_json(F.transform(acts, lambda a: a["observation"]))))
    several = F.raise_error(F.concat(F.lit("a control action beside others in one step: "), F.to_json(acts)))
    return (
        F.when(control & (F.size(acts) > 1), several.cast(f"array<{MESSAGE}>"))
        .when(first["name"] == dag.ASK, asked)
        .when(first["name"] == dag.ANSWER, F.array(_message("assistant", first["observation"])))
        .otherwise(F.concat(F.array(_message("assistant", F.lit(""), made)), seen))
    )


def history(tasks: DataFrame, dialogue: str = "dialogue", task: str = "task", consecutive: bool = True) -> DataFrame:
    """dialogue, number, task, role, content, calls: the gold answers of a dialogue's tasks as one run of messages.

    tasks: dialogue, task (a number within the dialogue), env, text, and answers, an array of structs of name,
    arguments, observation, user_input, deps (places in the array).  A task is its text and, step by step, the first
    of its shortest executions.  Number 0 is the system message with the first task's env.  The request for a task is
    the messages up to and including its text: those before it are its history.  Tasks without answers have their
    text alone; a dependency on no node, or in a circle, raises.
    """
    nodes = F.transform("answers", lambda a: F.struct(a["name"].alias("name"), a["deps"].alias("deps")))
    told = relational.settled(tasks.select(dialogue, task, "env", "text", "answers", dag.schedule_column(nodes).alias("__steps")))
    unfit = (F.size("answers") > 0) & (F.coalesce(F.size("__steps"), F.lit(0)) <= 0)
    steps = F.when(unfit, F.raise_error(F.concat(F.lit("answers without an order: "), F.col(task).cast("string"))).cast("array<array<int>>")).otherwise(F.col("__steps"))
    parts = F.transform(F.coalesce(steps, F.array().cast("array<array<int>>")), lambda s: step_messages(F.transform(s, lambda i: F.get("answers", i)), consecutive))
    whole = F.concat(F.array(_message("user", F.col("text"))), F.flatten(parts))
    rows = told.select(dialogue, task, F.posexplode(whole).alias("__place", "m")).select(dialogue, task, "__place", "m.*")
    begin = told.groupBy(dialogue).agg(F.min(task).alias(task), F.min_by("env", task).alias("env"))
    system = begin.select(dialogue, task, F.lit(-1).alias("__place"), _message("system", F.concat(F.lit("Current Date: "), "env")).alias("m"))
    both = rows.unionByName(system.select(dialogue, task, "__place", "m.*"))
    return calls.ranked(both, [dialogue], [task, "__place"], "number").select(dialogue, "number", task, "role", "content", "calls")
