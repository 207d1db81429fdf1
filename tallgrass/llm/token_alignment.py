"""Operator 13: alignment of two tokenizers' tokens, with counts of linked ids.

Side A is a byte-level BPE file of the tokenizers library and reads a space and the text;
side B is a sentencepiece model, which adds the space itself.  Tokens of both sides are runs
of the same bytes, so their cumulative ends are two rising sequences of byte offsets.  Within
mapInPandas the two are merged by two pointers: a pointer into B's ends moves on until it
reaches the present end of A, for all tokens of a batch at once (`searchsorted` on sorted
ends).  Where both pointers stand at the same offset, a group of tokens ends, and the A and
the B token that end there are linked.  No token is empty, so an offset links one A to one B
token.  Each document's links are counted by pair of ids before they leave the task.

Spark then adds up the pairs over the corpus, joins each pair's count and the highest count
of its A id and of its B id back to the documents' pairs, and adds up by document.  Pairs are
told to the join by broadcast while there are at most BROADCAST_PAIRS of them; beyond, the
few pairs that make up more than one link in HOT_SHARE (at most HOT_SHARE of them) are
broadcast and the rest is joined by exchange, so no key holds many rows.  The maxima have at
most one row for each id of a vocabulary.

Cases: null and empty texts have no tokens, and neither have texts whose joined token bytes
on either side differ from the space and the text (a model that normalises does that): counts
are 0 and `groups` is ''.  Very long texts are encoded and merged whole.  Repeated rows count
each, also if they share a doc_id; a null doc_id is kept.  Ties for the highest count are all
highest.  An empty table gives no rows.  Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pairs of ids that may be told to a join by broadcast: 12 bytes each, about 40 as a hash table.
BROADCAST_PAIRS = 2_000_000
#: Beyond that: a pair with over 1 / HOT_SHARE of all links is hot; there are fewer than HOT_SHARE such.
HOT_SHARE = 50_000
#: Characters of one run without (or of) white space that the quicker encoder takes; its time is quadratic in them.
LONG_RUN = 2_000

ALIGNED = "doc_id string, n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>, links array<int>"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in their order, for the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        if not all(token_bytes):
            raise ValueError("a token without bytes can't be aligned")
        self.size = len(token_bytes)
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, self.size)
        self.bytes = pa.array(token_bytes, pa.large_binary())

    def spells(self, ids: np.ndarray, ends: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each document's ids, which end at `ends`, spell its bytes."""
        taken = self.bytes.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[np.append(0, ends)]
        view = memoryview(taken.buffers()[2] or b"")
        return np.fromiter((bytes(view[at[i] : at[i + 1]]) == own for i, own in enumerate(raw)), bool, len(raw))


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library.

    Where the file's merges come in the order of their ids, the ids by rank that tiktoken gives are the same
    and cost a third, so that it reads all texts but those with very long runs.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_of = byte_of_symbol()
        spelled = lambda entry: bytes(byte_of[c] for c in entry)
        vocabulary = told["model"]["vocab"]
        ranks = {spelled(entry): i for entry, i in vocabulary.items()}
        special = {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        by_id = {i: raw for raw, i in ranks.items()} | special
        if sorted(by_id) != list(range(len(by_id))):
            raise ValueError("ids have gaps")
        super().__init__([by_id[i] for i in range(len(by_id))])
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merges = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        in_order = [vocabulary["".join(m)] for m in merges] == list(range(256, len(ranks)))
        plain = told["normalizer"] is None and told["pre_tokenizer"] == BYTE_LEVEL
        if in_order and plain:
            import public_tokenizers

            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.by_rank = None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.by_rank is None or _has_long_run(text):
                out.append(np.array(self.library.encode(" " + text, add_special_tokens=False).ids, np.int64))
            else:
                out.append(np.array(self.by_rank.encode_ordinary(" " + text), np.int64))
        return out


#: Fixed value: the splitting that tiktoken's pattern repeats.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _has_long_run(text: str) -> bool:
    """Whether a run of either kind could be over LONG_RUN characters."""
    if len(text) <= LONG_RUN:
        return False
    words = text.split()
    return max(map(len, words), default=0) > LONG_RUN or len(text) - sum(map(len, words)) - len(words) > LONG_RUN


class Pieces(Side):
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = re.compile("<0x([0-9A-F]{2})>").fullmatch
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        super().__init__([bytes([int(m[1], 16)]) if (m := byte(p)) else p.replace("▁", " ").encode() for p in pieces])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> tuple[Side, Side, pa.Array]:
    """Both sides, and the texts of their ids with what follows them in `groups`."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    told = [f"{i}{mark}" for mark in (",", "|") for i in range(a.size)] + [f"{i}{mark}" for mark in (",", ";", "") for i in range(b.size)]
    return a, b, pa.array(told, pa.large_string())


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of them up to the end of each document."""
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.cumsum([len(p) for p in parts], dtype=np.int64)


def merged(texts: list[str | None], a: Side, b: Side, told: pa.Array) -> pd.DataFrame:
    """The columns of ALIGNED but doc_id for a batch of texts."""
    out = pd.DataFrame({"n_a": 0, "n_b": 0, "n_groups": 0, "groups": ""}, index=range(len(texts)))
    none = np.empty(0, np.int32)
    for name in ("a", "b", "links"):
        out[name] = [none] * len(texts)
    rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(rows):
        return out
    own = [texts[i] for i in rows]
    parts_a, parts_b, raw = a.ids(own), b.ids(own), [b" " + t.encode() for t in own]
    ids_a, last_a = _joined(parts_a)
    ids_b, last_b = _joined(parts_b)
    good = a.spells(ids_a, last_a, raw) & b.spells(ids_b, last_b, raw)
    if not good.all():
        rows = rows[good]
        if not len(rows):
            return out
        ids_a, last_a = _joined([p for p, ok in zip(parts_a, good) if ok])
        ids_b, last_b = _joined([p for p, ok in zip(parts_b, good) if ok])

    # both sides spell the same bytes, document after document, so ends can be counted through
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    there = np.searchsorted(ends_b, ends_a)
    close_a = ends_b[there] == ends_a
    group_a, group_b = np.flatnonzero(close_a), there[close_a]  # the tokens that end each group
    close_b = np.zeros(len(ids_b), bool)
    close_b[group_b] = True
    link_a, link_b = ids_a[group_a], ids_b[group_b]

    # texts of groups: the tokens of A, then those of B, group by group
    before_a, before_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
    mark = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark[np.arange(len(ids_a)) + np.append(0, group_b + 1)[before_a]] = ids_a + a.size * close_a
    kind = close_b.astype(np.int64)
    kind[last_b - 1] = 2
    mark[np.arange(len(ids_b)) + group_a[before_b] + 1] = 2 * a.size + ids_b + b.size * kind
    text = told.take(pa.array(mark))
    at = np.frombuffer(text.buffers()[1], np.int64, len(mark) + 1)[np.append(0, last_a + last_b)]
    view = memoryview(text.buffers()[2])

    # links of each document by pair of ids
    doc = np.searchsorted(last_a, group_a, side="right")
    pairs, times = np.unique((doc * a.size + link_a) * b.size + link_b, return_counts=True)
    pair_b = (pairs % b.size).astype(np.int32)
    pair_a = (pairs // b.size % a.size).astype(np.int32)
    cuts = np.searchsorted(pairs // (a.size * b.size), np.arange(1, len(rows)))

    count = lambda last: np.diff(last, prepend=0)
    for name, values in (
        ("n_a", count(last_a)),
        ("n_b", count(last_b)),
        ("n_groups", count(np.searchsorted(group_a, last_a))),
        ("groups", [str(view[s:e], "ascii") for s, e in zip(at, at[1:])]),
        ("a", np.split(pair_a, cuts)),
        ("b", np.split(pair_b, cuts)),
        ("links", np.split(times.astype(np.int32), cuts)),
    ):
        column = out[name].to_numpy(copy=True)
        for row, value in zip(rows, values):
            column[row] = value
        out[name] = column
    return out


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups and the document's links as arrays a, b, links (how often).

    One row for each row of `docs`.  `groups` is like `a1,a2|b1;a3|b2,b3` in decimal ids; a and b
    are the ids of each pair, in order.  Each executor must be able to open both files.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side_a, side_b, told = _sides(path_a, path_b)
        for frame in frames:
            out = merged([t if isinstance(t, str) else None for t in frame["text"]], side_a, side_b, told)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, since pandas has no null integers
    return keyed.mapInPandas(batches, ALIGNED).withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best_a, best_b: the links of each pair of ids in the corpus, and whether no pair of its A id (B id) has more."""
    each = aligned.select(F.explode(F.arrays_zip("a", "b", "links")).alias("x")).select("x.a", "x.b", "x.links")
    counts = cut(each.groupBy("a", "b").agg(F.sum("links").alias("count")))
    for side in ("a", "b"):
        # one row for each id of a vocabulary at most
        top = counts.groupBy(side).agg(F.max("count").alias(f"__top_{side}"))
        counts = counts.join(F.broadcast(top), side).withColumn(f"best_{side}", F.col("count") == F.col(f"__top_{side}"))
    return counts.select("a", "b", "count", "best_a", "best_b")


def _met(links: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """links with the count, best_a and best_b of their pair."""
    pair = ["a", "b"]
    if counts.limit(most + 1).count() <= most:
        return links.join(F.broadcast(counts), pair)
    counts = cut(counts)
    bar = counts.agg(F.sum("count")).first()[0] // HOT_SHARE
    hot = counts.where(F.col("count") > bar)  # fewer than HOT_SHARE rows
    rest = links.join(F.broadcast(hot.select(*pair)), pair, "left_anti")
    return links.join(F.broadcast(hot), pair).unionByName(rest.join(counts.where(F.col("count") <= bar), pair))


def scored(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of `aligned` with n_links, n_best_a, n_best_b, count_sum in place of a, b and links.

    n_best_a (n_best_b): links whose pair has the highest count of its A (B) id; count_sum: the counts of
    all links together.  `aligned` (the columns of `align`, of which `groups` may be replaced by others)
    is read twice, so it should be a written table.
    """
    keyed = cut(aligned.withColumn("__row", F.monotonically_increasing_id()))  # fixed by the written table
    links = keyed.select("__row", F.explode(F.arrays_zip("a", "b", "links")).alias("x")).select("__row", "x.a", "x.b", "x.links")
    met = _met(links, pair_counts(keyed), most)
    sums = met.groupBy(F.col("__row").alias("__doc")).agg(
        F.sum("links").alias("n_links"),
        F.sum(F.when(F.col("best_a"), F.col("links"))).alias("n_best_a"),
        F.sum(F.when(F.col("best_b"), F.col("links"))).alias("n_best_b"),
        F.sum(F.col("links") * F.col("count")).alias("count_sum"),
    )
    kept = [c for c in aligned.columns if c not in ("a", "b", "links")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (
        keyed.select("__row", *kept)
        .join(sums, F.col("__row") == F.col("__doc"), "left")
        .select(*kept, *map(zero, ("n_links", "n_best_a", "n_best_b", "count_sum")))
    )
