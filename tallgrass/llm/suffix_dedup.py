"""Operator 7: removal of repeated byte strings with a run-compressed suffix index.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

Routing.  Each window of `length` bytes names an anchor: its ANCHOR-byte substring of least
hash, the leftmost of equals.  Equal windows have equal anchors, so windows can only repeat
within one anchor's group.  Neighbouring windows with the same anchor form a fragment, of
about 1.4 times `length` bytes.  Anchors that occur once are done with.  Fragments that
occur twice or more are repeats as a whole, however often; counts tell, no list is kept.
There, and for hot anchors below, 64-bit hashes stand for the bytes.
What is left are anchors with several different fragments.

Index.  These fragments, one of each kind, are brought together by anchor and indexed in
batches of whole anchor groups: suffix array, Burrows-Wheeler transform, its runs, and the
suffixes at both ends of each run.  Only there are matches with the lexicographic neighbour
computed, by comparing bytes; within a run the match of the following position is shorter by
one.  Streaming through the fragments with these samples gives matching statistics: for each
position, the longest match with any other.  Where that is `length` or more, a window repeats.

An anchor with more than HOT different fragments is not gathered: its windows are hashed and
counted one by one, which pre-aggregates and needs no group in one task.

Cases: null text counts as empty; texts shorter than `length` bytes keep all; matches never
cross documents; very long texts are read whole, in segments of SEGMENT bytes that overlap;
rows that repeat a document are repeats of each other; equal doc_ids with different texts
are told apart by a hash of the text; rows of null doc_id lose their repeats as others do; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, text_or_empty

LENGTH = 200
ANCHOR = 24
SEGMENT = 1 << 23
#: An index takes some 105 bytes for each of its strings', and each core has one.
BATCH_BYTES = 1 << 20
TASK_BYTES = 12 << 20
HOT = 10_000
#: Documents that may be told to a scan by broadcast; 16 bytes each.
BROADCAST_DOCS = 300_000

_PLACE = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SECOND = np.uint64(0xD1342543DE82EF95)
_SECOND_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.base))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.inverse))])
        return self.up, self.down


_first, _second = Powers(_BASE, _INVERSE), Powers(_SECOND, _SECOND_INVERSE)


def _sums(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.of(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]), down


def _hashes(sums: np.ndarray, down: np.ndarray, starts, sizes) -> np.ndarray:
    return _mix((sums[starts + sizes] - sums[starts]) * down[starts] + np.uint64(1) * np.asarray(sizes).astype(np.uint64))


def fragments(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, start and size of the fragments of a text's bytes."""
    out = []
    step = SEGMENT - length + 1
    for offset in range(0, max(1, len(raw) - length + 1), step):
        part = raw[offset : offset + SEGMENT]
        if len(part) >= length:
            anchor, content, start, size = _segment(part, length)
            out.append((anchor, content, start + offset, size))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment(raw: np.ndarray, length: int):
    k = min(ANCHOR, length)
    span = length - k + 1  # anchors in a window
    with np.errstate(over="ignore"):
        sums, down = _sums(raw, _first)
        n = len(raw) - k + 1
        hashes = _mix((sums[k:] - sums[:-k]) * down[:n])
        keys = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
        blocks = np.concatenate([keys, np.full(-n % span, ~np.uint64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
        at = (least & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sizes = np.concatenate([starts[1:], [len(at)]]) - 1 - starts + length
        other, other_down = _sums(raw, _second)
        content = _hashes(sums, down, starts, sizes) ^ (_hashes(other, other_down, starts, sizes) >> np.uint64(1))
        return hashes[at[starts]], content, starts, sizes


def window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of `length` bytes, in order."""
    with np.errstate(over="ignore"):
        sums, down = _sums(raw, _second)
        starts = np.arange(len(raw) - length + 1)
        return _hashes(sums, down, starts, np.int64(length))


class RunIndex:
    """Runs of the Burrows-Wheeler transform of some strings, with the suffixes at their ends."""

    def __init__(self, strings: list[bytes]):
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)
        ends = self.starts[1:] - 1
        codes = joined.astype(np.uint64) + np.uint64(1)
        codes[ends] = 0  # of separators none equals another, nor goes on
        self.size = len(codes)
        self.packed = self._pack(codes)
        order = self._suffixes(ends)
        before = np.concatenate([codes[-1:], codes[:-1]])[order]  # the transform
        new_run = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        (self.heads,) = np.nonzero(new_run)
        tails = np.concatenate([self.heads[1:], [self.size]]) - 1
        #: text places at the ends of runs, each with its neighbour beyond the run
        self.samples = [
            (order[self.heads[1:]], order[self.heads[1:] - 1]),
            (order[tails[:-1]], order[tails[:-1] + 1]),
        ]

    def _pack(self, codes: np.ndarray) -> np.ndarray:
        """Seven codes of nine bits from each place on, with zeros after a separator."""
        packed, width = codes, 1
        for more in (1, 2, 3):
            nxt = np.concatenate([packed[width:], np.zeros(width, np.uint64)])[: self.size]
            if more < width:
                nxt = nxt >> np.uint64(9 * (width - more))
            goes_on = (packed & np.uint64(511)) != 0
            packed = (packed << np.uint64(9 * more)) | np.where(goes_on, nxt, np.uint64(0))
            width += more
        return packed

    def _suffixes(self, ends: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the compared prefix where suffixes still tie."""
        size = self.size
        left = np.repeat(ends, np.diff(self.starts)) - np.arange(size)  # bytes before the separator
        order = np.argsort(self.packed, kind="stable")
        rank = np.empty(size, np.int64)
        sorted_keys = self.packed[order]
        fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        slots = np.arange(size)
        rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots, width = slots[tied], 7
        while len(slots):
            own = order[slots]
            beyond = np.where(left[own] >= width, rank[np.minimum(own + width, size - 1)], own)
            key = rank[own].astype(np.uint64) << np.uint64(32) | beyond.astype(np.uint64)
            resort = np.argsort(key, kind="stable")
            own, key = own[resort], key[resort]
            order[slots] = own
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots, width = slots[tied], 2 * width
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes in common from places a and b on."""
        found = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = self.packed[a[live]], self.packed[b[live]]
            whole = (x == y) & ((x & np.uint64(511)) != 0)
            part = live[~whole]
            if len(part):
                unlike = (x ^ y)[~whole]
                got, clear, own = np.zeros(len(part), np.int64), np.ones(len(part), bool), x[~whole]
                for k in range(6, -1, -1):
                    shift = np.uint64(9 * k)
                    clear &= ((unlike >> shift) & np.uint64(511)) == 0
                    clear &= ((own >> shift) & np.uint64(511)) != 0
                    got += clear
                found[part] += got
            live = live[whole]
            found[live] += 7
            a, b = a.copy(), b.copy()
            a[live] += 7
            b[live] += 7
        return found

    def matching_statistics(self) -> np.ndarray:
        """For each place of the joined strings, the longest match with any other place."""
        best = np.zeros(self.size, np.int64)
        for places, others in self.samples:
            reach = np.zeros(self.size, np.int64)
            reach[places] = places + self._common(places, others)
            np.maximum.accumulate(reach, out=reach)
            best = np.maximum(best, reach - np.arange(self.size))
        return best


def repeated(strings: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string the merged ranges that are covered by repeated windows."""
    index = RunIndex(strings)
    hit = index.matching_statistics() >= length
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    (at,) = np.nonzero(hit)
    if not len(at):
        return out
    owner = np.searchsorted(index.starts, at, side="right") - 1
    for i, place in zip(owner.tolist(), (at - index.starts[owner]).tolist()):
        own = out[i]
        if own and place <= own[-1][1]:
            own[-1] = (own[-1][0], place + length)
        else:
            own.append((place, place + length))
    return out


_RANGES = "doc_id long, text_key long, start int, end int"
_RANGES_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _indexed(length: int):
    """Rows sorted by anchor -> ranges of the fragments that occur once."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("anchor", "n", "doc_id", "text_key", "start", "bytes")]
            for row in zip(*(c.to_pylist() for c in columns)):
                if size >= BATCH_BYTES and row[0] != last:
                    yield _ranges(held, length)
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[5])
        if held:
            yield _ranges(held, length)

    return run


def _ranges(rows: list[tuple], length: int) -> pa.RecordBatch:
    found = repeated([r[5] for r in rows], length)
    out = [
        (doc, key, start + a, start + b)
        for (_, n, doc, key, start, _), own in zip(rows, found)
        if n == 1  # the others are repeats as a whole, and known
        for a, b in own
    ]
    columns = zip(*out) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RANGES_ARROW)], schema=_RANGES_ARROW)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans, kept: the removed ranges and the other bytes of each row of `docs`."""
    spark = docs.sparkSession
    doc = ["doc_id", "text_key"]
    # joins want a doc_id; what a text repeats depends on the text only, so it may be another's
    key = F.coalesce("doc_id", F.lit(0)).alias("doc_id")
    texts = docs.select(key, F.col("doc_id").alias("own_id"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))

    struct = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])

    @F.arrow_udf("array<struct<anchor:long,content:long,start:int,size:int>>")
    def cut_up(column: pa.Array) -> pa.Array:
        parts, ends = [], [0]
        for text in column:
            parts.append(fragments(np.frombuffer(text.as_py().encode(), np.uint8), length))
            ends.append(ends[-1] + len(parts[-1][0]))
        anchor, content, start, size = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        values = pa.StructArray.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
            fields=list(struct),
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    all_fragments = cut(texts.select(*doc, F.inline(cut_up("text"))))
    often = cut(all_fragments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    shared = cut(all_fragments.join(often, "anchor"))
    drop(all_fragments)
    kind = ["anchor", "content", "size"]
    kinds = cut(
        shared.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*doc, "start")).alias("x")).select(*kind, "n", "x.*")
    )
    twice = cut(kinds.where("n > 1").select(*kind))
    whole = shared.join(twice, kind).select(*doc, "start", (F.col("start") + F.col("size")).alias("end"))
    variety = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    unlike = cut(kinds.join(variety, "anchor"))
    ranges = cut(
        whole.unionByName(_by_index(texts, unlike.where(f"kinds <= {HOT}"), doc, length))
        .unionByName(_by_windows(texts, unlike.where(f"kinds > {HOT}"), doc, length))
        .groupBy(*doc)
        .agg(F.collect_set(F.struct("start", "end")).alias("ranges"))  # as often as the document is repeated, each is the same
    )

    @F.arrow_udf("struct<spans:array<struct<start:int,end:int>>,kept:binary>")
    def rest(column: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(column, lists):
            raw, spans, kept, done = text.as_py().encode(), [], [], 0
            for r in sorted((r["start"], r["end"]) for r in found.as_py() or []):
                if spans and r[0] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], r[1])
                else:
                    spans.append({"start": r[0], "end": r[1]})
            for s in spans:
                kept.append(raw[done : s["start"]])
                done = s["end"]
            kept.append(raw[done:])
            out.append({"spans": spans, "kept": b"".join(kept)})
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(out, pa.struct([("spans", span), ("kept", pa.binary())]))

    touched, others = _parted(texts, ranges, doc)
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    own_id = F.col("own_id").alias("doc_id")
    changed = touched.join(ranges, doc).select(own_id, n_bytes, rest("text", "ranges").alias("x")).select("doc_id", "n_bytes", "x.*")
    no_span = F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    as_it_was = others.select(own_id, n_bytes, no_span, F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(as_it_was)


def _parted(texts: DataFrame, of: DataFrame, doc: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of `texts` with and without a match in `of`; no text of the latter moves if `of` is small."""
    keys = of.select(*doc)
    if keys.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        keys = F.broadcast(keys)
    return texts.join(keys, doc, "left_semi"), texts.join(keys, doc, "left_anti")


def _with_text(texts: DataFrame, kinds: DataFrame, doc: list[str]) -> DataFrame:
    """Each kind's fragment as bytes, from the one document that stands for it."""
    per_doc = cut(
        kinds.groupBy(*doc).agg(F.collect_list(F.struct("anchor", "n", "start", "size")).alias("own"))  # bounded by the text
    )
    texts = _parted(texts, per_doc, doc)[0].select(*doc, "text")
    repeated = texts.groupBy(*doc).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():  # rows that repeat a document are one here
        texts = texts.dropDuplicates(doc)
    found = texts.join(per_doc, doc)
    raw = F.col("text").cast("binary")
    pieces = F.transform(
        "own",
        lambda x: F.struct(
            x["anchor"].alias("anchor"),
            x["n"].alias("n"),
            x["start"].alias("start"),
            F.substring(F.col("raw"), x["start"] + 1, x["size"]).alias("bytes"),
        ),
    )
    return found.withColumn("raw", raw).select(*doc, F.inline(pieces))


def _by_index(texts: DataFrame, kinds: DataFrame, doc: list[str], length: int) -> DataFrame:
    total = kinds.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(12, total // TASK_BYTES + 1)
    rows = _with_text(texts, kinds, doc).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return rows.select("anchor", "n", *doc, "start", "bytes").mapInArrow(_indexed(length), _RANGES)


def _by_windows(texts: DataFrame, kinds: DataFrame, doc: list[str], length: int) -> DataFrame:
    """For anchors of many kinds: count the windows themselves."""

    @F.arrow_udf("array<long>")
    def hashed(column: pa.Array) -> pa.Array:
        found = [window_hashes(np.frombuffer(x.as_py(), np.uint8), length).view(np.int64) for x in column]
        return pa.array(found, pa.list_(pa.int64()))

    rows = _with_text(texts, kinds, doc).select("anchor", "n", *doc, "start", F.posexplode(hashed("bytes")).alias("at", "window"))
    rows = cut(rows)
    twice = cut(rows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor", "window"))
    begin = (F.col("start") + F.col("at")).cast("int")
    return rows.where("n = 1").join(twice, ["anchor", "window"]).select(*doc, begin.alias("start"), (begin + length).alias("end"))
