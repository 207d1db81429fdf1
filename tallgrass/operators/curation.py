"""Curation of a tool catalog from the edges to nearest neighbours.

Edges have tool_type, tool_name, neighbor_type, neighbor_name, raw, similarity and rank;
thresholds are held against the unrounded similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.operators import relational

ORIGINAL, SYNTHETIC = "original", "synthetic"
ISOLATED, GAP, UNRELATED, CROSS_PARENT, QUALITY = 0.75, 0.75, 0.65, 0.75, 0.95


def parent_of(df: DataFrame, columns=("_source_tool", "created_from", "parent", "original_tool"), strict: bool = False) -> Column:
    """The tool from which a synthetic one was made; `strict` leaves out the generator's own field."""
    use = [c for c in columns if c in df.columns and not (strict and c == "_source_tool")]
    return F.coalesce(*[F.col(c).cast("string") for c in use], F.lit(None).cast("string"))


def isolated(edges: DataFrame, threshold: float = ISOLATED) -> DataFrame:
    """Tools whose nearest neighbour is below the threshold."""
    return edges.where((F.col("rank") == 1) & (F.col("raw") < threshold))


def gaps(tools: DataFrame, edges: DataFrame, threshold: float = GAP, least: int = 5) -> DataFrame:
    """tool_name, close, missing: tools with fewer than `least` neighbours at the threshold or above."""
    close = edges.where(F.col("raw") >= threshold).groupBy("tool_name").agg(F.count(F.lit(1)).alias("close"))
    found = tools.join(close, "tool_name", "left").withColumn("close", F.coalesce("close", F.lit(0)).cast("long"))
    return found.select("tool_name", "close", F.greatest(F.lit(0), least - F.col("close")).cast("long").alias("missing")).where("missing > 0")


def gap_total(found: DataFrame) -> DataFrame:
    """tools, missing: how many tools have gaps, and what they lack together."""
    return found.agg(F.count(F.lit(1)).alias("tools"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing"))


def clashing(synthetic: DataFrame, original: DataFrame) -> DataFrame:
    """Rule 1: synthetic tools with the name of an original one."""
    return synthetic.join(original.select("tool_name").distinct(), "tool_name", "left_semi")


def unrelated(synthetic: DataFrame, edges: DataFrame, threshold: float = UNRELATED) -> DataFrame:
    """Rule 2: synthetic tools near an original one that is not their parent."""
    near = edges.where((F.col("tool_type") == SYNTHETIC) & (F.col("neighbor_type") == ORIGINAL) & (F.col("raw") > threshold))
    hits = synthetic.join(near.select("tool_name", "neighbor_name"), "tool_name")
    return hits.where(~F.col("neighbor_name").cast("string").eqNullSafe(F.col("parent").cast("string"))).select("tool_name").distinct()


def cross_edges(synthetic: DataFrame, edges: DataFrame, threshold: float = CROSS_PARENT) -> DataFrame:
    """tool_name, neighbor_name, rank: near pairs of surviving synthetic tools of different parents."""
    near = edges.where((F.col("tool_type") == SYNTHETIC) & (F.col("neighbor_type") == SYNTHETIC) & (F.col("raw") > threshold))
    own = synthetic.select("tool_name", F.col("parent").cast("string").alias("own_parent"))
    other = synthetic.select(F.col("tool_name").alias("neighbor_name"), F.col("parent").cast("string").alias("other_parent"))
    pairs = near.select("tool_name", "neighbor_name", "rank").join(own, "tool_name").join(other, "neighbor_name")
    return pairs.where(F.col("own_parent") != F.col("other_parent")).select("tool_name", "neighbor_name", "rank")


def crossing_set(synthetic: DataFrame, edges: DataFrame, threshold: float = CROSS_PARENT) -> DataFrame:
    """Rule 3 as a set: both ends of every such pair."""
    pairs = cross_edges(synthetic, edges, threshold)
    return pairs.select(F.explode(F.array("tool_name", "neighbor_name")).alias("tool_name")).distinct()


def crossing_greedy(synthetic: DataFrame, edges: DataFrame, threshold: float = CROSS_PARENT) -> DataFrame:
    """Rule 3 in scan order (column ord of `synthetic`, different for each tool).

    A tool that is not yet marked when its turn comes marks itself and its first such neighbour.  So a tool acts
    unless an earlier tool that acts has it as its first neighbour.  Each round decides all tools at once whose
    earlier tools of that kind are all decided: the least of the undecided tools is one of them, so rounds end, and
    the result is the scan's.  There are as many rounds as tools in the longest chain of first neighbours of rising
    ord, and a round's joins hold the undecided ones only.
    """
    pairs = cross_edges(synthetic, edges, threshold).join(synthetic.select("tool_name", "ord"), "tool_name")
    first = relational.settled(pairs.groupBy("tool_name").agg(F.first("ord").alias("ord"), F.min_by("neighbor_name", F.struct("rank", "neighbor_name")).alias("marks")))
    later = first.select(F.col("tool_name").alias("marks"), F.col("ord").alias("later"))
    # source, target: the target is a tool of its own turn after the source's
    waits = first.join(later, "marks").where("ord < later").select(F.col("tool_name").alias("source"), F.col("marks").alias("target"))
    waits = relational.settled(waits)
    undecided = first.select("tool_name")
    acting = None
    while True:
        blocked = waits.select(F.col("target").alias("tool_name"))
        now = relational.settled(undecided.join(blocked, "tool_name", "left_anti"))
        acting = now if acting is None else acting.unionByName(now)
        # those whom an acting tool marks are decided too: they don't act
        struck = waits.join(now.select(F.col("tool_name").alias("source")), "source", "left_semi").select(F.col("target").alias("tool_name"))
        decided = relational.settled(now.unionByName(struck).distinct())
        undecided = relational.settled(undecided.join(decided, "tool_name", "left_anti"))
        if not undecided.limit(1).count():
            break
        gone = decided.select(F.col("tool_name").alias("source"))
        kept = waits.join(gone, "source", "left_anti").join(gone.select(F.col("source").alias("target")), "target", "left_anti")
        waits = relational.settled(kept.select("source", "target"))
    marks = first.join(acting, "tool_name", "left_semi")
    return marks.select(F.explode(F.array("tool_name", "marks")).alias("tool_name")).distinct()


def judged(synthetic: DataFrame, original: DataFrame, edges: DataFrame, unrelated_at=UNRELATED, cross_at=CROSS_PARENT, mode="greedy") -> DataFrame:
    """The synthetic tools with `rule`: the first rule (1 to 3) that a tool breaks, or 0.  The edges are written once for both rules."""
    edges = relational.settled(edges)
    marked = lambda df, rule: df.select("tool_name").distinct().withColumn(f"rule{rule}", F.lit(rule))
    one = synthetic.join(marked(clashing(synthetic, original), 1), "tool_name", "left")
    two = one.join(marked(unrelated(one.where("rule1 IS NULL").drop("rule1"), edges, unrelated_at), 2), "tool_name", "left")
    last = crossing_greedy if mode == "greedy" else crossing_set
    two = relational.settled(two)
    left = two.where("rule1 IS NULL AND rule2 IS NULL").drop("rule1", "rule2")
    three = two.join(marked(last(left, edges, cross_at), 3), "tool_name", "left")
    return three.withColumn("rule", F.coalesce("rule1", "rule2", "rule3", F.lit(0))).drop("rule1", "rule2", "rule3")


def gold_report(original: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts before, by rule, and after, from the original tools and `judged` ones."""
    by_rule = [F.count_if(F.col("rule") == n).alias(f"rule{n}") for n in (1, 2, 3)]
    counts = found.agg(F.count(F.lit(1)).alias("synthetic"), *by_rule, F.count_if(F.col("rule") == 0).alias("kept"))
    both = original.agg(F.count(F.lit(1)).alias("original")).join(counts, F.lit(True))  # one row a side
    return both.withColumn("gold", F.col("original") + F.col("kept"))


def filled(edges: DataFrame, synthetic: DataFrame, most: int = 5) -> DataFrame:
    """tool_name, shown, kind, place: a tool's neighbours by rank, then the tools made from it, `most` at most.

    A tool that is among the neighbours is not shown again; synthetic ones come in the order of
    column ord.
    """
    near = edges.where(F.col("rank") <= most).select("tool_name", F.col("neighbor_name").alias("shown"), F.lit("neighbor").alias("kind"), F.col("rank").cast("long").alias("at"))
    made = synthetic.where("parent IS NOT NULL").select(F.col("parent").alias("tool_name"), F.col("tool_name").alias("shown"), F.lit("synthetic").alias("kind"), F.col("ord").cast("long").alias("at"))
    made = made.join(near.select("tool_name", "shown"), ["tool_name", "shown"], "left_anti")
    order = Window.partitionBy("tool_name").orderBy("kind", "at", "shown")
    return near.unionByName(made).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("at")


def kept(original: DataFrame, found: DataFrame) -> DataFrame:
    """tool_name, tool_type: the original tools and those of `judged` that break no rule."""
    both = original.select("tool_name", F.lit(ORIGINAL).alias("tool_type"))
    return both.unionByName(found.where("rule = 0").select("tool_name", F.lit(SYNTHETIC).alias("tool_type")))


def gold(synthetic: DataFrame, original: DataFrame, edges: DataFrame, unrelated_at=UNRELATED, cross_at=CROSS_PARENT, mode="greedy") -> DataFrame:
    """Original tools and the synthetic ones that pass all three rules."""
    return kept(original, judged(synthetic, original, edges, unrelated_at, cross_at, mode))


def quality(edges: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """One row of counters over the typed edges."""
    cross = F.col("tool_type") != F.col("neighbor_type")
    copy = (F.col("tool_type") == SYNTHETIC) & (F.col("neighbor_type") == ORIGINAL) & (F.col("raw") > threshold) & (F.col("rank") <= 3)
    return edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(cross & (F.col("raw") > threshold) & (F.col("rank") <= 2)).alias("cross_type"),
        F.count_if(copy).alias("copies"),
        F.countDistinct(F.when(copy, F.col("tool_name"))).alias("copying_tools"),
    )


def copies(edges: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """tool_name, originals: synthetic tools with the original ones that they nearly repeat."""
    near = edges.where((F.col("tool_type") == SYNTHETIC) & (F.col("neighbor_type") == ORIGINAL) & (F.col("raw") > threshold) & (F.col("rank") <= 3))
    return near.groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_name", "similarity"))).alias("originals"))


def warnings(edges: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """tool_name, warned: whether a synthetic tool has an original neighbour above the threshold at any rank."""
    near = (F.col("neighbor_type") == ORIGINAL) & (F.col("raw") > threshold)
    return edges.where(F.col("tool_type") == SYNTHETIC).groupBy("tool_name").agg(F.bool_or(near).alias("warned"))
