"""Generation of dialogues around models: paths of task types, checks and clean-up of transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import calls, relational

#: Single tool, several tools, question for a missing parameter, chat.
TASK_TYPES = ("ST", "MT", "CQ", "CC")
ASK, ANSWER = "ask_user_for_required_parameters", "prepare_to_answer"


def task_paths(spark: SparkSession, length: int, types: Sequence[str] = TASK_TYPES) -> DataFrame:
    """path: all sequences of 1 to `length` task types.

    Each is a number in base len(types), so no path depends on another.
    """
    b = len(types)
    parts = []
    for n in range(1, length + 1):
        digits = [F.element_at(F.array(*map(F.lit, types)), (F.pmod(F.floor(F.col("id") / b ** (n - 1 - i)), F.lit(b)) + 1).cast("int")) for i in range(n)]
        parts.append(spark.range(b**n).select(F.array(*digits).alias("path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def path_at(number: Column, length: int, types: Sequence[str] = TASK_TYPES) -> Column:
    """The path of a number, in the order of `task_paths`: shorter paths first, then as numbers in base len(types).

    Numbers beyond the last path start again at the first one.
    """
    b = len(types)
    names, starts = F.array(*map(F.lit, types)), [sum(b**m for m in range(1, n)) for n in range(1, length + 2)]
    own = F.pmod(number, F.lit(starts[-1]))
    out = None
    for n, (start, end) in enumerate(zip(starts, starts[1:]), 1):
        digits = [F.get(names, F.pmod(F.floor((own - start) / b ** (n - 1 - i)), F.lit(b)).cast("int")) for i in range(n)]
        out = F.when(own < end, F.array(*digits)) if out is None else out.when(own < end, F.array(*digits))
    return out


def speaker(content: Column) -> Column:
    """Who speaks, from how a message starts."""
    out = F.when(content.startswith("Switch"), "Switch")
    for name in ("User", "Planner", "Tool", "Agent", "Checker"):
        out = out.when(content.startswith(name), name)
    return out


def is_tool_result(content: Column) -> Column:
    """A tool's message, with a colon of either width."""
    return content.rlike("^Tool[:：]")


def block(content: Column) -> Column:
    """The text of the first fenced JSON block, or null."""
    found = F.regexp_extract(content, r"(?s)```json(.+?)```", 1)
    return F.when(found != "", found)


def cleaned(messages: Column) -> Column:
    """Messages (structs with content) as training rows.

    Switches and checkers go; a checker that says no takes the last kept message with it.
    """
    def step(kept: Column, m: Column) -> Column:
        c = m["content"]
        verdict = F.try_variant_get(F.try_parse_json(block(c)), "$.correct", "string")
        checker = c.startswith("Checker")
        return (
            F.when(c.startswith("Switch"), kept)
            .when(~checker, F.concat(kept, F.array(m)))
            .when(F.coalesce(verdict == "no", F.lit(False)), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(kept)
        )

    return F.aggregate(messages, F.slice(messages, 1, 0), step)


def draw(options: Column, *seed: Column | str) -> Column:
    """One element of an array, by a hash of the seed columns: random, and alike on every run."""
    return F.get(options, F.pmod(F.xxhash64(*seed), F.size(options)).cast("int"))


def draw_answer(content: Column, prefix: str, *seed: Column | str) -> Column:
    """A value of a JSON object, which may stand in a fence, behind a speaker's prefix."""
    text = F.coalesce(block(content), content)
    return F.concat(F.lit(prefix), draw(F.map_values(F.from_json(text, "map<string,string>")), *seed))


def random_moment(year: int, *seed: Column | str) -> Column:
    """A second of a year with its weekday, as text."""
    start = F.unix_timestamp(F.lit(f"{year}-01-01 00:00:00"))
    seconds = F.unix_timestamp(F.lit(f"{year + 1}-01-01 00:00:00")) - start
    return F.date_format(F.timestamp_seconds(start + F.pmod(F.xxhash64(*seed), seconds)), "yyyy-MM-dd HH:mm:ss EEEE")


def filled(template: str, **values: Column) -> Column:
    """A prompt with {{{name}}} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{{{{{name}}}}}}}"), value)
    return out


def plan_errors(thought: Column, plan: Column, actions: Column, after_tool: Column, tools: DataFrame, rows: DataFrame) -> DataFrame:
    """id, errors: which rules a planner's block breaks; none for a sound one.

    rows: id and the columns meant by the arguments; actions: array<struct<name string,
    arguments map<string,string>>>, null where the block can't be parsed.  tools: name,
    properties, required.  Lists within arguments are JSON text.
    """
    known = tools.select(F.col("name").alias("tool"), "properties", "required")
    base = rows.select("id", thought.alias("thought"), plan.alias("plan"), actions.alias("actions"), after_tool.alias("after_tool"))
    names = F.transform("actions", lambda a: a["name"])
    mentions = lambda c, w: F.coalesce(F.col(c).contains(w), F.lit(False))
    whole = base.select(
        "id",
        F.array_compact(
            F.array(
                F.when(F.col("actions").isNull(), "format"),
                F.when(mentions("thought", "simulated execution") | mentions("plan", "simulated execution"), "simulation"),
                F.when(mentions("thought", "Checker") | mentions("plan", "Checker"), "checker"),
                F.when(F.size("actions") == 0, "empty"),
            )
        ).alias("errors"),
    )
    each = base.select("id", "after_tool", F.size(F.array_distinct(names)).alias("kinds"), F.explode("actions").alias("a"))
    each = each.select("id", "after_tool", "kinds", F.col("a.name").alias("tool"), F.col("a.arguments").alias("arguments"))
    met = each.join(known, "tool", "left")
    asked = known.select(F.col("tool").alias("asked"), F.col("required").alias("asked_required"))
    met = met.withColumn("asked", F.when(F.col("tool") == ASK, F.col("arguments")["tool_name"])).join(asked, "asked", "left")
    given = F.map_keys("arguments")
    control = F.col("tool").isin(ASK, ANSWER)
    mixed = control & (F.col("kinds") > 1)
    wanted = F.coalesce(F.from_json(F.col("arguments")["missing_required_parameters"], "array<string>"), F.array().cast("array<string>"))
    kind = F.col("arguments")["answer_type"]
    alone_ask, alone_answer = (F.col("tool") == ASK) & ~mixed, (F.col("tool") == ANSWER) & ~mixed
    per_action = met.select(
        "id",
        F.array_compact(
            F.array(
                F.when(F.col("properties").isNull(), "unknown tool"),
                F.when(F.size(F.array_except(given, "properties")) > 0, "unknown argument"),
                F.when(F.exists("required", lambda r: F.col("arguments")[r] == ""), "empty required"),
                F.when(F.size(F.array_except("required", given)) > 0, "missing required"),
                F.when(mixed, "control not alone"),
                F.when(alone_ask & F.col("asked_required").isNull(), "asked unknown tool"),
                F.when(alone_ask & (F.size(F.array_except(wanted, "asked_required")) > 0), "asked not required"),
                F.when(alone_answer & ~F.coalesce(kind.isin("tool", "chat"), F.lit(False)), "answer type"),
                F.when(alone_answer & F.col("after_tool") & (kind == "chat"), "chat after tool"),
            )
        ).alias("errors"),
    )
    both = whole.unionByName(per_action).groupBy("id").agg(F.collect_set("errors").alias("e"))
    return both.select("id", F.array_sort(F.array_distinct(F.flatten("e"))).alias("errors"))


def observations_match(actions: Column, observations: Column) -> Column:
    """A tool's block parses and has one observation for each action."""
    return F.coalesce((F.size(actions) == F.size(observations)) & (F.size(actions) >= 0), F.lit(False))


def following(previous: Column) -> Column:
    """Which speakers may follow one: the transitions of the state machine."""
    to = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(previous.isin("User", "Tool"), to("Planner"))
        .when(previous == "Checker", to("Planner", "Tool", "Agent"))
        .when(previous == "Planner", to("Checker", "Tool", "Agent"))
        .when(previous == "Agent", to("User"))
        .otherwise(to("User", "Planner", "Tool", "Agent", "Checker"))
    )


def first_illegal(messages: DataFrame, dialogue: str = "dialogue", turn: str = "turn") -> DataFrame:
    """dialogue, turn, before, speaker: the first turn of each dialogue that may not follow the one before it, else nulls.

    messages: dialogue, turn, content, which says who speaks.  Switches take no turn of their own.  A dialogue opens
    with the user (`before` is then empty); a message of no known speaker is never allowed, and nothing is checked
    after the first such turn.  Places come from numbers over the table, so a long dialogue is no single task.
    """
    rows = messages.select(dialogue, turn, F.coalesce(speaker(F.col("content")), F.lit("")).alias("__who"))
    said = calls.ranked(rows.where("__who <> 'Switch'"), [dialogue], [turn], "__at")
    said = relational.settled(said)
    earlier = said.select(F.col(dialogue).alias("__dialogue"), (F.col("__at") + 1).alias("__next"), F.col("__who").alias("before"))
    met = said.join(earlier, F.col(dialogue).eqNullSafe(F.col("__dialogue")) & (F.col("__at") == F.col("__next")), "left")
    opening = F.col("before").isNull() & (F.col("__who") == "User")
    allowed = F.when(F.col("before").isNull(), opening).when(F.col("before") == "", False).otherwise(F.array_contains(following(F.col("before")), F.col("__who")))
    wrong = met.where(~allowed).select(dialogue, F.col(turn), F.coalesce("before", F.lit("")).alias("before"), F.col("__who").alias("speaker"))
    first = wrong.groupBy(F.col(dialogue).alias("__d")).agg(F.min_by(F.struct(turn, "before", "speaker"), turn).alias("w"))
    every = messages.select(dialogue).distinct()
    found = every.join(first, F.col(dialogue).eqNullSafe(F.col("__d")), "left")
    return found.select(dialogue, F.col(f"w.{turn}").alias(turn), "w.before", "w.speaker")


def _control(name: str, what: str, required: dict[str, dict]) -> dict:
    """A definition whose parameters are all required."""
    parameters = {"type": "object", "properties": required, "required": list(required)}
    return {"type": "function", "function": {"name": name, "description": what, "parameters": parameters}}


#: The control tools' names, their parameters' names and types, and the kinds of an answer.  The descriptions are not fixed.
CONTROL_TOOLS = [
    _control(
        ASK,
        "Stop and let the user fill in what a call still lacks.",
        {"tool_name": {"type": "string"}, "missing_required_parameters": {"type": "array", "items": {"type": "string"}}},
    ),
    _control(ANSWER, "All calls are done, or none is needed.", {"answer_type": {"type": "string", "enum": ["tool", "chat"]}}),
]

#: How a user goes on after an answer, and how many variants of each there are to draw from.
FOLLOW_UPS = {"reference": 7, "omission": 4, "addition": 2, "modification": 2, "continuation": 5, "switch": 2}


def follow_up(*seed: Column | str) -> Column:
    """A struct of style and variant (from 0), all variants being equally likely, by a hash of the seed columns."""
    options = [F.struct(F.lit(style).alias("style"), F.lit(n).alias("variant")) for style, count in FOLLOW_UPS.items() for n in range(count)]
    return draw(F.array(*options), *seed)


def without_control_tools(tools: Column) -> Column:
    """An array of tool structs with a name, less the two control tools."""
    return F.filter(tools, lambda t: ~t["name"].isin(ASK, ANSWER))
