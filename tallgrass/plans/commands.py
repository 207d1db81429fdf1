"""The commands as functions from tables to tables, with their defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import schemas, text
from tallgrass.operators import curation, dag, evaluation, records, relational, terms, vectors


def rendered(tools: DataFrame) -> DataFrame:
    """Tools (as readers give them) with their text."""
    at = lambda x, path, kind: F.try_variant_get(F.try_parse_json(x), path, kind)
    parameters = F.transform(
        F.map_entries("properties"),
        lambda e: F.struct(
            e["key"].alias("name"),
            at(e["value"], "$.type", "string").alias("type"),
            at(e["value"], "$.description", "string").alias("description"),
            F.coalesce(at(e["value"], "$.enum", "array<string>"), F.array().cast("array<string>")).alias("options"),
        ),
    )
    return tools.withColumn("text", text.tool_text(F.col("name"), F.col("description"), parameters, F.col("required")))


Embedder = Callable[[DataFrame], DataFrame]


def tfidf_embedder(most: int = 5_000, size: int = 128) -> Embedder:
    """id, v from id, text without a model: TF-IDF on its strongest directions."""
    return lambda rows: terms.project_texts(rows, most, size)


def analyze(tools: DataFrame, tasks: DataFrame, embed: Embedder | None = None, k: int = 5, clusters: int = 0, isolated_at: float = curation.ISOLATED) -> dict[str, DataFrame]:
    """neighbors, clusters, task_stats, isolated, overview, summary and vectors of a catalog.

    tools: one of each name, as readers give them; tasks: name, ord, text.
    """
    texts = rendered(tools).select(F.col("ord").alias("id"), "name", "description", "text")
    stats = terms.task_stats(texts, tasks)
    with_tasks = texts.join(stats, "name").withColumn("text", F.when(F.col("examples") != "", F.concat("text", F.lit("\nExample tasks: "), "examples")).otherwise(F.col("text")))
    v = relational.settled((embed or tfidf_embedder())(with_tasks.select("id", "text")))
    names = texts.select("id", "name")
    near = vectors.neighbours(v, k)
    edges = near.join(names.withColumnsRenamed({"id": "query", "name": "tool_name"}), "query").join(
        names.withColumnsRenamed({"id": "item", "name": "neighbor_name"}), "item"
    )
    edges = relational.settled(edges.select("tool_name", "neighbor_name", "raw", "similarity", "rank"))
    n = tools.count()
    own = terms.kmeans(v, terms.cluster_count(clusters, n)) if n else v.select("id", F.lit(0).alias("cluster"))
    counts = own.join(with_tasks, "id").select("cluster", F.explode(text.tokens(F.col("text"))).alias("term"))
    labels = terms.labels(counts.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n")))
    labelled = own.join(labels, "cluster", "left").withColumn("label", terms.label_or_default(F.col("label"), F.col("cluster")))
    members = labelled.join(texts, "id")
    alone = curation.isolated(edges, isolated_at).select("tool_name", F.col("similarity").alias("top_neighbor_similarity"))
    return {
        "neighbors": edges.select("tool_name", "neighbor_name", "similarity", "rank"),
        "clusters": members.join(stats, "name").select(F.col("name").alias("tool_name"), F.col("cluster").alias("cluster_id"), F.col("label").alias("cluster_label"), "task_count", F.col("examples").alias("task_samples")),
        "task_stats": stats.select(F.col("name").alias("tool_name"), "task_count", F.col("examples").alias("example_tasks")),
        "isolated": alone.join(members.withColumnRenamed("name", "tool_name"), "tool_name").select("tool_name", "top_neighbor_similarity", F.col("cluster").alias("cluster_id"), F.col("label").alias("cluster_label"), "description"),
        "overview": terms.overview(members.select("cluster", F.col("id").alias("ord"), "name", "description")).join(labels, "cluster", "left"),
        "summary": texts.agg(F.count(F.lit(1)).alias("tools")).join(alone.agg(F.count(F.lit(1)).alias("isolated")), F.lit(True)).join(own.agg(F.countDistinct("cluster").alias("clusters")), F.lit(True)),
        "vectors": v,
    }


def typed_edges(original: DataFrame, synthetic: DataFrame, embed: Embedder, k: int = 5) -> DataFrame:
    """Edges between all tools of both kinds, each told by kind and name."""
    both = relational.union_tagged({curation.ORIGINAL: rendered(original), curation.SYNTHETIC: rendered(synthetic)}, "tool_type")
    ids = relational.numbered(both.select("tool_type", "name", "ord", "text"), ["tool_type", "ord"], "id")
    names = ids.select("id", "tool_type", F.col("name").alias("tool_name"))
    found = vectors.neighbours(embed(ids.select("id", "text")), k)
    other = names.withColumnsRenamed({"id": "item", "tool_type": "neighbor_type", "tool_name": "neighbor_name"})
    return found.join(names.withColumnRenamed("id", "query"), "query").join(other, "item").drop("query", "item")


def quality(original: DataFrame, synthetic: DataFrame, embed: Embedder | None = None, k: int = 5) -> dict[str, DataFrame]:
    """neighbors, report and copies of both catalogs together."""
    edges = relational.settled(typed_edges(original, synthetic, embed or tfidf_embedder(), k))
    return {"neighbors": edges, "report": curation.quality(edges), "copies": curation.copies(edges)}


def rebuild(original: DataFrame, synthetic: DataFrame, embed: Embedder | None = None, k: int = 5, mode: str = "greedy") -> dict[str, DataFrame]:
    """Dedupe both catalogs, then neighbors, the gold catalog and its reports.

    original and synthetic are the deduplicated catalogs, report the counts before and after, rules those by the rule
    that took a tool.
    """
    first = lambda df: relational.first_by(df.where(F.col("name").isNotNull()), ["name"], ["ord"])
    kept_original, kept_synthetic = first(original), first(synthetic)
    edges = relational.settled(typed_edges(kept_original, kept_synthetic, embed or tfidf_embedder(), k))
    named = lambda df: df.withColumnRenamed("name", "tool_name")
    judged = relational.settled(curation.judged(named(kept_synthetic), named(kept_original), edges, mode=mode))
    keep = curation.kept(named(kept_original), judged)
    rules = curation.gold_report(named(kept_original), judged)
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("original_before", original), ("synthetic_before", synthetic), ("original_after", kept_original), ("synthetic_after", kept_synthetic), ("gold", keep))]
    out = counts[0]
    for one in counts[1:]:
        out = out.join(one, F.lit(True))
    return {"neighbors": edges, "gold": keep, "report": out, "rules": rules, "original": kept_original, "synthetic": kept_synthetic}


def regroup(tools: DataFrame, size: int = 5) -> DataFrame:
    """chunk, items: JSON texts of consecutive tools, `size` to a line."""
    return relational.chunks(tools, ["ord"], size, F.col("json"))


def expand(tools: DataFrame, edges: DataFrame, tasks: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None, threshold: float = curation.GAP, least: int = 5, offset: int = 0, most: int = 0) -> DataFrame:
    """source, name, description, parameters, required of tools generated to fill gaps.

    generate takes rows name, json, missing, neighbours, examples and returns source, json; the
    default varies the tool's name, so that all around a model can be run without one.
    """
    found = curation.gaps(tools.select(F.col("name").alias("tool_name")), edges, threshold, least)
    ordered = found.orderBy("tool_name").offset(offset)
    rows = (ordered.limit(most) if most else ordered).withColumnRenamed("tool_name", "name").join(tools.select("name", "json"), "name")
    near = relational.first_by(edges.where(F.col("rank") <= 5).groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_name"))).alias("x")), ["tool_name"], ["tool_name"])
    rows = rows.join(near.select(F.col("tool_name").alias("name"), F.transform("x", lambda e: e["neighbor_name"]).alias("neighbours")), "name", "left")
    examples = terms.task_stats(tools, tasks).select("name", "examples")
    rows = rows.join(examples, "name")
    made = generate(rows) if generate else rows.select(
        F.col("name").alias("source"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("missing").cast("int")), lambda i: F.concat(F.col("name"), F.lit("_variant_"), i.cast("string")))).alias("new"),
        "json",
    ).select("source", F.replace(F.col("json"), F.concat(F.lit('"name":"'), "source", F.lit('"')), F.concat(F.lit('"name":"'), "new", F.lit('"'))).alias("json"))
    return described(made)


def described(made: DataFrame) -> DataFrame:
    """source, name, description, parameters, required, json: names joined by commas, in document order."""
    at = lambda path, kind: F.try_variant_get(F.try_parse_json("json"), path, kind)
    properties = F.get_json_object("json", "$.function.parameters.properties")
    return made.select(
        "source",
        at("$.function.name", "string").alias("name"),
        at("$.function.description", "string").alias("description"),
        F.coalesce(F.array_join(F.json_object_keys(properties), ", "), F.lit("")).alias("parameters"),
        F.coalesce(F.array_join(at("$.function.parameters.required", "array<string>"), ", "), F.lit("")).alias("required"),
        "json",
    )


def parsed_lines(reply: Column) -> Column:
    """array<string> of the tool objects in a model's reply (see records.generated_tools)."""
    return records.generated_tools(reply)


def prepare_schemas(tools: DataFrame) -> dict[str, DataFrame]:
    """cache: one document of fixed tools; errors: what is still wrong with each."""
    fixed = tools.withColumn("json", schemas.fixed_column(F.col("json")))
    errors = fixed.select("name", F.explode(schemas.definition_errors_column(F.col("json"))).alias("error"))
    return {"tools": fixed, "errors": errors}


def evaluate(tasks: DataFrame) -> dict[str, DataFrame]:
    """The six metrics of evaluated tasks (see operators.metrics)."""
    from tallgrass.operators import metrics

    several = F.col("kind").contains("Multi-Tool")
    return {
        "total": metrics.totals(tasks),
        "type": metrics.by_kind(tasks, "Multi-Tool", several),
        "layer": metrics.by_layer(tasks),
        "turn": metrics.by_turn(tasks),
        "optimal": metrics.optimal(tasks, ["Parallel Multi-Tool", "Mixed Multi-Tool"]),
        "progress": metrics.progress(tasks, ["Sequential Multi-Tool", "Mixed Multi-Tool"]),
    }


# ---- from result files to metrics ----

_LIST = "array<variant>"


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def logged_steps(results: DataFrame) -> DataFrame:
    """dialogue, pos, step, name_label, predicted, gold: the steps of result lines (id, json), calls as arrays of (name, arguments).

    Step numbers are those of the log's keys.  A result that is no list, as of a failed dialogue, has no steps.
    """
    told = F.try_parse_json("json")
    tasks = results.select(F.col("id").alias("dialogue"), F.posexplode(_at(told, "$.result", _LIST)).alias("pos", "t"))
    log = _at(F.col("t"), "$.inference_log", "map<string,variant>")
    steps = tasks.select("dialogue", "pos", F.explode(F.map_filter(log, lambda k, _: k.startswith("step_"))).alias("key", "s"))

    def calls_of(path: str, inner: str) -> Column:
        own = F.coalesce(_at(F.col("s"), path, _LIST), F.array().cast(_LIST))
        argument = lambda c: F.coalesce(_at(c, f"$.{inner}arguments", "string"), F.to_json(_at(c, f"$.{inner}arguments", "variant")))
        return F.transform(own, lambda c: F.struct(_at(c, f"$.{inner}name", "string").alias("name"), argument(c).alias("arguments")))

    return steps.select(
        "dialogue",
        "pos",
        F.substring_index("key", "_", -1).cast("int").alias("step"),
        _at(F.col("s"), "$.inference_output.current_action_name_label", "string").alias("name_label"),
        calls_of("$.inference_output.tool_calls", "function.").alias("predicted"),
        calls_of("$.inference_answer.candidate_0_answer_function_list.action", "").alias("gold"),
    )


def score(results: DataFrame, benchmark: DataFrame) -> dict[str, DataFrame]:
    """labels and the six metrics of a model's result lines against the benchmark's records, both id and json text.

    A task's calls are checked by the definitions of its own record, under which floats are numbers; equal definitions
    of several records are one.  All tasks of a dialogue that failed (its result is no list) are wrong; dialogues without
    a result line don't count.
    """
    record = F.try_parse_json("json")
    own = benchmark.select(F.col("id").alias("dialogue"), record.alias("r"), "json")
    definitions = own.select("dialogue", F.explode(records.chosen(F.col("json"), "tools")).alias("tool"))
    definitions = definitions.select("dialogue", records.tool_name(F.col("tool")).alias("name"), F.regexp_replace(F.to_json("tool"), r'"type"\s*:\s*"float"', '"type":"number"').alias("json"))
    parameters = F.coalesce(F.get_json_object("json", "$.function.parameters"), F.get_json_object("json", "$.parameters"), F.lit("{}"))
    definitions = definitions.select("dialogue", "name", parameters.alias("parameters")).where("name IS NOT NULL")
    definitions = relational.settled(definitions.withColumn("tool", F.concat("name", F.lit("#"), F.sha2("parameters", 256))))

    steps = relational.settled(logged_steps(results))
    control = F.coalesce(F.col("gold")[0]["name"].isin(dag.ASK, dag.ANSWER), F.lit(False))
    steps = steps.withColumn("control", control).withColumn("task", F.concat_ws("|", "dialogue", "pos"))
    looked = steps.where("name_label = 'correct' AND NOT control")

    def side(calls: str) -> DataFrame:
        rows = looked.select("dialogue", "task", "step", F.inline(calls))
        met = rows.join(definitions.select("dialogue", "name", "tool"), ["dialogue", "name"], "left")
        return met.select("task", "step", F.coalesce("tool", F.concat("name", F.lit("#"))).alias("name"), "arguments")

    # of a name that a record defines twice the definitions are one after the other; the last counts
    definitions = relational.settled(definitions.groupBy("dialogue", "name").agg(F.max(F.struct("tool", "parameters")).alias("d")).select("dialogue", "name", "d.*"))
    known = definitions.select(F.col("tool").alias("name"), "parameters").distinct()
    pairs = evaluation.checked_pairs(side("predicted"), side("gold"), known, ["task", "step"])

    told = F.try_parse_json("json")
    listed = _at(told, "$.result", _LIST)
    kinds = own.select("dialogue", F.posexplode(_at(F.col("r"), "$.english_task_types", "array<string>")).alias("pos", "kind"), "r")
    subtypes, answers = _at(F.col("r"), "$.english_turn_subtypes", "array<string>"), F.coalesce(*(_at(F.col("r"), f"$.{name}", "array<array<variant>>") for name in ("english_answer_list", "answer_list")))
    kinds = kinds.select("dialogue", "pos", "kind", F.get(subtypes, F.col("pos") - 1).alias("subtype"), F.coalesce(F.size(F.get(answers, F.col("pos"))), F.lit(0)).alias("expected"))
    done = results.select(F.col("id").alias("dialogue"), listed.alias("l"))
    tasks = done.join(kinds, "dialogue").withColumn("t", F.get("l", F.col("pos"))).where("l IS NULL OR t IS NOT NULL")
    tasks = tasks.select(
        "dialogue", "pos", "kind", "subtype", "expected", F.concat_ws("|", "dialogue", "pos").alias("task"),
        F.coalesce(_at(F.col("t"), "$.action_name_label", "string"), F.lit("error")).alias("name_label"),
        F.coalesce(_at(F.col("t"), "$.is_optimal", "boolean"), F.lit(False)).alias("is_optimal"),
    )
    tasks = relational.settled(tasks)
    labels = evaluation.task_labels(tasks.select("task", "name_label", "is_optimal"), evaluation.step_labels(steps, pairs))
    found = tasks.select("task", "dialogue", "pos", "kind", "subtype", "expected").join(labels, "task")
    found = found.withColumn("correct", F.col("label") == evaluation.CORRECT).withColumnRenamed("steps", "done")
    found = relational.settled(found)
    return {"labels": found.drop("task")} | evaluate(found)
