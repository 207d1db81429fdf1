"""Operator 4: exact deduplication by progressive refinement.

Texts are compared after each run of white space became one blank.  Rows are grouped by
the length of that text, and each such group by a hash of its first characters; a row
alone in its group has no copy.  Only the other rows are hashed in full, and grouped by
that.  Both first groupings take one exchange of small rows, since a group by length and
prefix is a part of its group by length.

The rows that stay are told by aggregates (partial on each side of the exchange) and a
join that adaptive execution splits, so a text that a third of all rows share is not
gathered in one task.

Cases: null text counts as empty, so null, "" and " " differ only in that blank (null
equals ""); very long texts are read whole; of equal texts the smallest doc_id stays;
rows that repeat a doc_id with equal texts each count in group_size and share the decision
of that doc_id; a row of null doc_id stays only where no row of its text has a doc_id (keep_id
is then null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WHITE = r"[\x20\x09-\x0D]+"
PREFIX = 256
#: Surviving (length, prefix) keys that may be broadcast to a second scan; about 40 bytes each.
BROADCAST_KEYS = 100_000


def normalised(col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    text_sha256 is null for rows without a candidate, unless `digest_all`.
    """
    text = docs.select("doc_id", normalised().alias("norm"))
    head = (F.octet_length("norm").cast("long").alias("size"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"))
    full = F.sha2("norm", 256)
    if digest_all:  # the digest of every text is asked for, so one scan gives all columns
        rows = cut(text.select("doc_id", *head, full.alias("full")))
        keys = _candidates(rows)
        hashed = rows.join(keys, ["size", "head"], "left_semi")
    else:
        rows = cut(text.select("doc_id", *head))
        keys = cut(_candidates(rows))
        again = text.select("doc_id", *head, "norm")
        if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            again = again.join(F.broadcast(keys), ["size", "head"], "left_semi")
        # beyond that bound every text is hashed where it is read, which moves no text
        hashed = cut(again.select("doc_id", "size", "head", full.alias("full")))
    groups = cut(
        hashed.groupBy("size", "head", "full")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    if not digest_all:
        alone = rows.join(keys, ["size", "head"], "left_anti").select("doc_id", F.lit(None).cast("string").alias("full"))
        hashed = hashed.join(keys, ["size", "head"], "left_semi")
        return _told(hashed, groups).unionByName(_told(alone, None))
    return _told(rows, groups)


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "head")


def _told(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        found = rows.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    else:
        found = rows.join(groups.select("full", "keep_id", "group_size"), "full", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
