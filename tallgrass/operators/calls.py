"""Tool calls: one form for all, ids, and predicted calls beside gold ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.operators import relational

#: Fixed value: what the ids of calls start with.
ID_PREFIX = "toolu_bdrk_"
ID_LENGTH = 24


def normalised(calls: Column) -> Column:
    """Calls as structs of id and function (name, arguments); a null list counts as empty.

    The elements are structs of id, name, arguments and function.  One that has a function stays
    as it is; one with a name alone gets an id from its place and `{}` for missing arguments; one
    with neither raises.
    """

    def one(call: Column, place: Column) -> Column:
        whole = F.struct(call["id"].alias("id"), call["function"].alias("function"))
        made = F.struct(
            F.coalesce(call["id"], F.concat(F.lit(ID_PREFIX), place.cast("string"))).alias("id"),
            F.struct(call["name"].alias("name"), F.coalesce(call["arguments"], F.lit("{}")).alias("arguments")).alias("function"),
        )
        refused = F.raise_error(F.concat(F.lit("a call needs a function or a name: "), F.to_json(call)))
        return F.when(call["function"].isNotNull(), whole).when(call["name"].isNotNull(), made).otherwise(refused)

    return F.transform(F.coalesce(calls, F.array()), one)


def split_parameters(names: Column, required: Column) -> Column:
    """Struct of required and optional: the names in their order, by whether `required` has them; null lists count as empty."""
    all_names, needed = F.coalesce(names, F.array().cast("array<string>")), F.coalesce(required, F.array().cast("array<string>"))
    return F.struct(
        F.filter(all_names, lambda x: F.array_contains(needed, x)).alias("required"),
        F.filter(all_names, lambda x: ~F.array_contains(needed, x)).alias("optional"),
    )


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Places from 0 within each key.  They come from numbers over the whole table, so that a hot key is no single task."""
    rows = relational.settled(relational.numbered(df, [*key, *order], "__nth"))
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min("__nth").alias("__first"))
    same = [rows[c].eqNullSafe(first[f"__{c}"]) for c in key]
    return rows.join(first, same).select(*df.columns, (F.col("__nth") - F.col("__first")).alias(name))


def paired(predicted: DataFrame, gold: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, place, predicted, gold: calls of both sides by their place in the order of name and arguments.

    Both have the key, name and arguments.  Where a side has fewer calls, its struct is null; a null key meets no other.
    """
    sides = []
    for rows, name in ((predicted, "predicted"), (gold, "gold")):
        placed = ranked(rows.select(*key, "name", "arguments"), key, ["name", "arguments"])
        sides.append(placed.select(*key, "place", F.struct("name", "arguments").alias(name)))
    return sides[0].join(sides[1], [*key, "place"], "full")


def queue_places(messages: DataFrame, conversation: str = "conversation", turn: str = "turn") -> DataFrame:
    """The rows with `pushed`, the calls asked before the row, and `taken`, the place of the call that a tool message answers.

    A conversation's calls wait in a queue, first in, first out.  A tool message takes the first one; if none waits,
    it takes nothing (null) and the queue goes on from empty.  With s the running sum of calls made less tool messages,
    the queue has been found empty as often as s has fallen to a new least value below 0, so a message's place is the
    number of tool messages up to it, less those misses.  Sums and least values run within ranges of the table and are
    carried from range to range, so that one long conversation is no single task.  (conversation, turn) is a key.
    """
    made = F.when(F.col("role") == "assistant", F.greatest(F.coalesce("calls", F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("long")
    tool = F.coalesce(F.col("role") == "tool", F.lit(False)).cast("long")
    ranged = messages.repartitionByRange(conversation, turn).withColumn("__part", F.spark_partition_id())
    rows = relational.settled(ranged.withColumn("__made", made).withColumn("__tool", tool))
    inside = Window.partitionBy("__part", conversation).orderBy(turn)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__sum", F.sum(F.col("__made") - F.col("__tool")).over(upto))
    rows = rows.withColumn("__least", F.min("__sum").over(upto)).withColumn("__least_before", F.min("__sum").over(before))
    rows = rows.withColumn("__pushed", F.coalesce(F.sum("__made").over(before), F.lit(0))).withColumn("__tools", F.sum("__tool").over(upto))
    # one row for each conversation and range; few conversations are in several ranges
    totals = rows.groupBy("__part", conversation).agg(
        F.sum("__made").alias("made"), F.sum("__tool").alias("tools"), F.min("__least").alias("least")
    )
    earlier = Window.partitionBy(conversation).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__made0", F.coalesce(F.sum("made").over(earlier), F.lit(0))).withColumn("__tools0", F.coalesce(F.sum("tools").over(earlier), F.lit(0)))
    totals = totals.withColumn("__low", F.col("__made0") - F.col("__tools0") + F.col("least"))
    carried = totals.select(
        F.col("__part").alias("__p"), F.col(conversation).alias("__c"), "__made0", "__tools0", F.least(F.lit(0), F.coalesce(F.min("__low").over(earlier), F.lit(0))).alias("__least0")
    )
    met = rows.join(carried, (F.col("__part") == F.col("__p")) & F.col(conversation).eqNullSafe(F.col("__c")))
    start = F.col("__made0") - F.col("__tools0")
    least_before = F.least(F.col("__least0"), F.coalesce(start + F.col("__least_before"), F.lit(0)))
    least = F.least(F.col("__least0"), start + F.col("__least"))
    missed = least < least_before
    place = F.when((F.col("__tool") == 1) & ~missed, F.col("__tools0") + F.col("__tools") + least - 1)
    return met.select(*messages.columns, (F.col("__made0") + F.col("__pushed")).alias("pushed"), place.alias("taken"))


def with_call_ids(messages: DataFrame, conversation: str = "conversation", turn: str = "turn") -> DataFrame:
    """conversation, turn, role, ids: ids of a message's calls, or of the call that a tool message answers.

    `messages` has role and calls, the number of calls that need an id.  An id is a digest of
    conversation, turn and place, so that a retry gives the same.  Tool messages take the ids from a
    queue, as `queue_places` says; ids is empty where nothing waited.
    """
    rows = relational.settled(queue_places(messages.select(conversation, turn, "role", "calls"), conversation, turn))
    key, at = F.col(conversation), F.col(turn)
    places = F.sequence(F.lit(0), F.col("calls").cast("int") - 1)
    call = rows.where((F.col("role") == "assistant") & (F.col("calls") > 0)).select(conversation, turn, "pushed", F.explode(places).alias("call"))
    call = call.withColumn("id", F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(F.concat_ws("|", key, at, "call"), 256), 1, ID_LENGTH)))
    own = call.groupBy(conversation, turn).agg(F.array_sort(F.collect_list(F.struct("call", "id"))).alias("x"))
    own = own.select(conversation, turn, F.transform("x", lambda e: e["id"]).alias("ids"))
    asked = call.select(conversation, (F.col("pushed") + F.col("call")).alias("taken"), "id")
    answers = rows.where("taken IS NOT NULL").select(conversation, turn, "taken").join(asked, [conversation, "taken"])
    found = own.unionByName(answers.select(conversation, turn, F.array("id").alias("ids")))
    return rows.join(found, [conversation, turn], "left").select(
        conversation, turn, "role", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    )
