"""Operator 2: near-duplicates by Order MinHash and banded alignment.

Words are runs of letters and digits in lower case; a text's shingles are its runs of five
words (all its words if it has fewer), each labelled with how often it occurred before.  A
sketch of a text is the TAKE shingles of least hash, joined in the order of the text, so it
agrees between texts with the probability that these are shared *and* in the same order:
sensitive to edit similarity, unlike the plain minimum.  Texts that share one of SKETCHES
sketches are candidates.

A candidate pair is verified by a banded alignment of the two sequences of shingles.  With
M aligned shingles the similarity is M / (n + m - M); pairs of at least 0.8 are links, and
classes are the connected components of links.  The band is as wide as the insertions and
deletions that such a similarity admits, so nothing is lost by it.

Large groups.  Equal texts are one node.  In each round every bucket of equal sketches whose
texts are in different classes draws LEADERS of them, and its texts are held against those
only, which is linear in the bucket.  Rounds go on as long as they still join classes in
number.  Then each text outside its bucket's largest class is held against the members of
other classes, so no link between texts of different classes is missed; by that time such
pairs are few, however dense a group is.  Pairs are first held against a bound from the
texts' parity bits, within the join; only pairs that pass it are made and aligned.

Cases: texts without a letter or digit are equal only to the same text (null equals the
empty text); very long texts are aligned whole; the class id is the least doc_id of the
class, and that document is kept; rows that repeat a doc_id are each returned; rows of null
doc_id are classed as others, and such a row is kept, as one document, only where its class
has no doc_id (class_id is then null); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, cut_and_count, drop
from .components import components

WORDS = 5
SKETCHES = 12
TAKE = 3
#: Parity bits of a text's shingles, by which most pairs are told apart without their texts.
BITS = 1_024
#: Leaders that a bucket draws in each round.
LEADERS = 4
#: Rounds of leaders end when one links fewer pairs than this share of the texts in question.
STILL = 0.02
#: Similarity 0.8 = 4/5: M / (n + m - M) >= 4/5 is 9 M >= 4 (n + m).
UP, DOWN = 4, 5
#: Candidates, or pairs of them, that may be told to a scan by broadcast; about 60 bytes each.
BROADCAST_TEXTS = 200_000
#: Rows of a task that writes a table, where the session's partitions would hold fewer; tasks there are at least.
TASK_ROWS, LEAST_TASKS = 20_000, 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(col: str = "text"):
    """The words of a text, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(norm: str) -> np.ndarray:
    """64-bit hashes of the shingles of words joined by single blanks, in order."""
    raw = np.frombuffer(norm.encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(raw), _BASE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
        (gaps,) = np.nonzero(raw == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        size = min(WORDS, len(starts))
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
        back = np.cumprod(np.full(len(raw), _INVERSE))
        return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each hash occurred before."""
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    nth = np.arange(len(hashes)) - np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    out = np.empty(len(hashes), np.uint64)
    out[order] = nth.astype(np.uint64)
    return out


_SEEDS = np.array([(slot + 1) * 0xA0761D6478BD642F & (1 << 64) - 1 for slot in range(SKETCHES)], np.uint64)[:, None]


def signature(norm: str) -> tuple[int, list[int], list[int]]:
    """Number of shingles, their parity bits as 64-bit words, and SKETCHES sketches; signed.

    Nothing but 0 and empty lists for a text without words.
    """
    found = shingles(norm)
    if not len(found):
        return 0, [], []
    with np.errstate(over="ignore"):
        labelled = found + occurrences(found) * np.uint64(0xD6E8FEB86659FD93)
        if len(found) * SKETCHES <= 1 << 20:
            least = _least(_mix(labelled[None, :] ^ _SEEDS))
        else:
            least = np.concatenate([_least(_mix(labelled[None, :] ^ seed[None, :])) for seed in _SEEDS])
        total = np.zeros(SKETCHES, np.uint64)
        for h in found[np.sort(least, axis=1)].T:
            total = _mix(total * _BASE + h)
        odd = np.bincount((_mix(labelled) >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return len(found), bits.tolist(), total.view(np.int64).tolist()


def _least(mixed: np.ndarray) -> np.ndarray:
    """Places of the TAKE least of each row."""
    if mixed.shape[1] <= TAKE:
        return np.broadcast_to(np.arange(mixed.shape[1]), mixed.shape)
    return np.argpartition(mixed, TAKE - 1, axis=1)[:, :TAKE]


def may_be_similar(n: Column, bits: Column, m: Column, other: Column) -> Column:
    """False only for pairs that can't be similar.

    Aligned shingles are at most the lesser number, and at most (n + m - unlike bits) / 2,
    since each shingle that is in one text only turns one parity bit.
    """
    unlike = sum((F.bit_count(F.get(bits, i).bitwiseXOR(F.get(other, i))) for i in range(BITS // 64)), F.lit(0))
    return (F.least(n, m) * (UP + DOWN) >= (n + m) * UP) & (unlike * (UP + DOWN) <= n + m)


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """The longest common subsequence of a and b, if it is `need` at least; else some smaller number.

    The band: in an alignment of `need` or more, partners are at most len(a) + len(b) - 2 need apart.
    """
    n, m = len(a), len(b)
    size = min(n, m)
    if size < need:
        return 0
    unlike = np.nonzero(a[:size] != b[:size])[0]
    head = int(unlike[0]) if len(unlike) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    unlike = np.nonzero(a[len(a) - size :][::-1] != b[len(b) - size :][::-1])[0]
    tail = int(unlike[0]) if len(unlike) else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    fixed, band = head + tail, n + m - 2 * need
    if fixed >= need or not len(a) or not len(b):
        return fixed
    places: dict[int, list[int]] = {}
    for i, h in enumerate(a.tolist()):
        places.setdefault(h, []).append(i)
    other = b.tolist()
    # with each hash on one place only, rising places are a common subsequence already
    rising: list[int] = []
    for h in other:
        at = places.get(h)
        if at and len(at) == 1:
            k = bisect_left(rising, at[0])
            rising[k : k + 1] = at
    if fixed + len(rising) >= need:
        return fixed + len(rising)
    counts = Counter(other)
    both = sum(min(len(at), counts[h]) for h, at in places.items())
    if fixed + both < need:
        return fixed
    # bits of a's places: a set bit of `free` is a row where the column's best has not risen
    bits = {h: sum(1 << i for i in p) for h, p in places.items()}
    every = (1 << len(a)) - 1
    free = every
    for j, h in enumerate(other):
        hit = bits.get(h)
        if hit:
            low, high = max(0, j - band), min(len(a), j + band + 1)
            hit &= ((1 << high) - 1) ^ ((1 << low) - 1)
            same = free & hit
            free = ((free + same) | (free - same)) & every
    return fixed + len(a) - free.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the aligned shingles make up 0.8 or more of all."""
    if not len(a) or not len(b):
        return False
    n = len(a) + len(b)
    need = -(-UP * n // (UP + DOWN))
    return aligned(a, b, need) >= need


_LONGS = T.ArrayType(T.LongType())


@F.arrow_udf(T.StructType().add("n", T.LongType()).add("bits", _LONGS).add("sketches", _LONGS))
def _signed(norms: pa.Array) -> pa.Array:
    n, bits, sketches = zip(*[signature(x.as_py() or "") for x in norms]) if len(norms) else ([], [], [])
    longs = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(bits, longs), pa.array(sketches, longs)], ["n", "bits", "sketches"])


@F.arrow_udf(T.BooleanType())
def _verified(firsts: pa.Array, seconds: pa.Array) -> pa.Array:
    known: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in known:
            if len(known) > 200:
                known.clear()
            known[text] = shingles(text)
        return known[text]

    return pa.array([similar(of(a.as_py() or ""), of(b.as_py() or "")) for a, b in zip(firsts, seconds)], pa.bool_())


BUCKET = ["slot", "sketch"]


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row for each row of `docs`."""
    texts = _keyed(docs)
    rows, n_rows = cut_and_count(texts.select("doc_id", "text_key", _signed("norm").alias("x")).select("doc_id", "text_key", "x.*"))
    same = [F.first(c).alias(c) for c in ("n", "bits", "sketches")]  # alike in all rows of a text
    tasks = _tasks(n_rows)
    alone = rows.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *same)
    # a node is a number from here on, fixed as it is written: least ones are then found without a sort
    nodes = cut(alone.coalesce(tasks).withColumn("key", F.monotonically_increasing_id()))
    buckets = nodes.select("key", F.posexplode("sketches").alias("slot", "sketch"))
    shared = buckets.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*BUCKET)
    shared = cut(shared.coalesce(tasks))
    members, n_members = cut_and_count(buckets.join(shared, BUCKET).coalesce(tasks))
    links = _links(docs, nodes, rows, members, tasks, _tasks(n_members))
    found = cut(components(links, tasks).coalesce(tasks))
    of_key = nodes.join(found.withColumnRenamed("node", "key"), "key", "left").select(
        "text_key", F.coalesce("root", "key").alias("root"), "rep", "copies"
    )
    of_key = cut(of_key.coalesce(tasks))  # read twice
    classes = cut(of_key.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")).coalesce(tasks))
    told = of_key.select("text_key", "root").join(classes, "root").select("text_key", "class_id", "class_size")
    told = cut(told.coalesce(tasks))
    return (
        rows.select("doc_id", "text_key")
        .join(told, "text_key")
        .select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    )


def _tasks(n: int) -> int:
    """How many tasks write a table of about `n` rows: rounds over few rows are many small stages."""
    return max(LEAST_TASKS, n // TASK_ROWS + 1)


def _links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, members: DataFrame, row_tasks: int, tasks: int) -> DataFrame:
    """a, b: verified links that connect every class of the candidates' graph; so many tasks for rows, and for members."""
    held = cut(_texts(docs, nodes, rows, members.select("key").distinct(), row_tasks))
    signed = nodes.select("key", "n", "bits", "sketches")
    apart, n_apart = cut_and_count(members.withColumn("root", F.col("key")).join(signed, "key").coalesce(tasks))
    links = tried = None
    turn = 0
    while True:
        pairs, n_pairs = cut_and_count(_new(_with_leaders(apart, turn, tasks), tried).coalesce(tasks))
        good, n_good = cut_and_count(_verify(pairs, n_pairs, held).coalesce(tasks))
        links = good if links is None else links.unionByName(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
        turn += 1
        still = n_good <= STILL * n_apart
        apart, n_apart = cut_and_count(_apart(members, links, tasks).join(signed, "key").coalesce(tasks))
        if turn > 1 and still:  # the first holds each text against one leader only
            break
    pairs, n_pairs = cut_and_count(_new(_with_others(apart, tasks), tried).coalesce(tasks))
    links = links.unionByName(cut(_verify(pairs, n_pairs, held).coalesce(tasks)))
    drop(held)
    return links


def _apart(members: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """key, slot, sketch, root: the members of the buckets that hold more than one class."""
    found = cut(components(links, tasks).coalesce(tasks)).withColumnRenamed("node", "key")
    rooted = cut(members.join(found, "key", "left").withColumn("root", F.coalesce("root", "key")).coalesce(tasks))
    split = rooted.groupBy(*BUCKET).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*BUCKET)
    return rooted.join(cut(split.coalesce(tasks)), BUCKET)


def _near() -> Column:
    return may_be_similar(F.col("n"), F.col("bits"), F.col("m"), F.col("lead_bits"))


def _leading(apart: DataFrame) -> DataFrame:
    named = {"key": "lead", "root": "other", "n": "m", "bits": "lead_bits", "sketches": "lead_sketches"}
    return apart.withColumnsRenamed(named)


def _with_leaders(apart: DataFrame, turn: int, tasks: int) -> DataFrame:
    """a, b: texts and leaders of their buckets that may be similar; in the first turn one leader a text."""
    draws = [F.xxhash64("key", *BUCKET, F.lit(LEADERS * turn + i)) for i in range(LEADERS)]
    drawn = apart.groupBy(*BUCKET).agg(*[F.min(d).alias(f"draw_{i}") for i, d in enumerate(draws)])
    is_drawn = reduce(Column.__or__, [d == F.col(f"draw_{i}") for i, d in enumerate(draws)])
    lead = _leading(apart.join(cut(drawn.coalesce(tasks)), BUCKET).where(is_drawn).select(apart.columns))
    lead = cut(lead.coalesce(tasks))
    pairs = apart.join(lead, BUCKET).where((F.col("root") != F.col("other")) & _near())
    if not turn:  # the one with which the text shares most sketches
        pairs = pairs.groupBy("key", "lead").agg(F.count(F.lit(1)).alias("times"))
        pairs = pairs.groupBy("key").agg(F.max_by("lead", F.struct("times", "lead")).alias("lead"))
    return pairs.select("key", "lead")


def _with_others(apart: DataFrame, tasks: int) -> DataFrame:
    """key, lead: all pairs of a bucket in different classes that may be similar, each once."""
    sizes = apart.groupBy(*BUCKET, "root").agg(F.count(F.lit(1)).alias("size"))
    main = cut(sizes.groupBy(*BUCKET).agg(F.max_by("root", F.struct("size", "root")).alias("main")).coalesce(tasks))
    lead = cut(_leading(apart.join(main, BUCKET).where("root <> main")).coalesce(tasks))
    # by one of its ends, in the first of its buckets
    once = (F.col("root") == F.col("main")) | (F.col("key") < F.col("lead"))
    alike = F.zip_with("sketches", "lead_sketches", lambda x, y: x == y)
    once &= F.array_position(alike, F.lit(True)) == F.col("slot") + 1
    return apart.join(lead, BUCKET).where((F.col("root") != F.col("other")) & _near() & once).select("key", "lead")


def _new(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """a, b: the pairs key, lead that were not tried yet, in order, each once."""
    pairs = pairs.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _verify(pairs: DataFrame, n_pairs: int, held: DataFrame) -> DataFrame:
    """The pairs a, b, of which there are n_pairs, whose texts are similar.

    Few pairs are told to the texts' scan, so that texts without one stay where they are and a leader's texts are dealt by pair.
    """
    few = n_pairs <= BROADCAST_TEXTS

    def end(key: str) -> DataFrame:
        own = held.select(F.col("key").alias(key), F.col("norm").alias(f"text_{key}"))
        return own.join(F.broadcast(pairs), key) if few else own

    both = end("a").join(end("b"), ["a", "b"]) if few else pairs.join(end("a"), "a").join(end("b"), "b")
    return both.where(_verified("text_a", "text_b")).select("a", "b")


def _bounded(keys: DataFrame) -> DataFrame:
    """A hint to broadcast the keys if there are few; else Spark joins them by exchange."""
    return F.broadcast(keys) if keys.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else keys


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, norm: the words of each text, and a hash of them (of the text itself if it has none)."""
    norm = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), words_of().alias("norm"))
    told = F.when(F.col("norm") != "", F.col("norm")).otherwise(F.concat(F.lit("\0"), "raw"))
    return norm.select("doc_id", F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("text_key"), "norm")


def _texts(docs: DataFrame, nodes: DataFrame, rows: DataFrame, wanted: DataFrame, tasks: int) -> DataFrame:
    """key, norm of the wanted keys, from one document of each."""
    of = F.xxhash64("doc_id").alias("of")  # null ids too; of equal hashes a key may come twice, which does no harm
    reps = wanted.join(nodes.select("key", "text_key", "rep"), "key").withColumnRenamed("rep", "doc_id")
    reps = cut(reps.select("key", "text_key", of).coalesce(tasks))
    few = docs.select("doc_id", "text", of).join(_bounded(reps.select("of").distinct()), "of", "left_semi")
    found = _keyed(few).withColumn("of", of).join(_bounded(reps), ["of", "text_key"]).select("key", "norm")
    repeated = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found if repeated.isEmpty() else found.dropDuplicates(["key"])
