"""Conversations as stateful sessions: turns arrive in any order, and each is passed on once, in its place.

A session takes its turns from 0 on without gaps.  A turn that comes early waits in the session's state until those
before it have come; one that comes again is left out.  A session ends with the turn that holds the stop word, or with
the reply to its last allowed question (`most` user turns); what comes later is left out.  `sessions` runs over a stream,
with its state keyed by conversation, and gives what `batch_sessions` gives over a table that holds each turn once.

State holds the next turn, the number of questions, whether the session ended, and the waiting turns by number; a session
that ended keeps no waiting turns.  State and offsets are in the query's checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tallgrass.operators import calls

#: Fixed value: what ends a session.
STOP = "TERMINATE"
#: Questions of a session at most.
MOST = 10
#: The provider that keyed state with maps needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TURNS = "conversation long, turn long, role string, content string"
PASSED = "conversation long, turn long, role string, content string, questions long, ends boolean"


class Session(StatefulProcessor):
    """Passes on a conversation's turns in order, up to its end."""

    def __init__(self, most: int, stop: str):
        self.most, self.stop = most, stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, questions long, ended boolean")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, questions, ended = self.place.get() if self.place.exists() else (0, 0, False)
        for frame in rows:
            for turn, role, content in zip(frame["turn"], frame["role"], frame["content"]):
                if not ended and turn >= following and not self.waiting.containsKey((int(turn),)):
                    self.waiting.updateValue((int(turn),), (role, content))
        out = []
        while not ended and self.waiting.containsKey((following,)):
            role, content = self.waiting.getValue((following,))
            self.waiting.removeKey((following,))
            questions += role == "user"
            # the last question still has its reply
            ended = self.stop in (content or "") or (questions >= self.most and role == "assistant") or questions > self.most
            if questions <= self.most:
                out.append((key[0], following, role, content, questions, ended))
            following += 1
        if ended:
            self.waiting.clear()
        self.place.update((following, questions, ended))
        yield pd.DataFrame(out, columns=["conversation", "turn", "role", "content", "questions", "ends"])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, most: int = MOST, stop: str = STOP) -> DataFrame:
    """The turns (schema TURNS, a stream) that are passed on, with the number of questions so far and whether the session ends."""
    keyed = turns.select("conversation", "turn", "role", "content").where("conversation IS NOT NULL AND turn >= 0")
    return keyed.groupBy("conversation").transformWithStateInPandas(Session(most, stop), PASSED, "Append", "None")


def serve_sessions(turns: DataFrame, out: str, checkpoint: str, most: int = MOST, stop: str = STOP) -> StreamingQuery:
    """All turns that have come so far, into Parquet; run again with the same folders, it goes on."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    passed = sessions(turns, most, stop)
    return passed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_sessions(turns: DataFrame, most: int = MOST, stop: str = STOP) -> DataFrame:
    """What `sessions` passes on, from a table: conversation, turn, role, content, questions, ends.

    Places come from numbers over the table; the running number of questions is a window over a conversation's turns.
    """
    rows = turns.select("conversation", "turn", "role", "content").where("conversation IS NOT NULL AND turn >= 0")
    placed = calls.ranked(rows, ["conversation"], ["turn"], "place").where(F.col("place") == F.col("turn"))
    upto = Window.partitionBy("conversation").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = placed.withColumn("questions", F.sum((F.coalesce(F.col("role") == "user", F.lit(False))).cast("long")).over(upto))
    ends = F.coalesce(F.col("content").contains(stop), F.lit(False)) | ((F.col("questions") >= most) & F.coalesce(F.col("role") == "assistant", F.lit(False)))
    last = asked.where(ends & (F.col("questions") <= most)).groupBy("conversation").agg(F.min("turn").alias("__last"))
    met = asked.join(last, "conversation", "left").where((F.col("questions") <= most) & (F.col("__last").isNull() | (F.col("turn") <= F.col("__last"))))
    return met.select("conversation", "turn", "role", "content", "questions", F.coalesce(F.col("turn") == F.col("__last"), F.lit(False)).alias("ends"))
