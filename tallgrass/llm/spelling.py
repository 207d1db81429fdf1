"""Operator 12: spelling variants, words that are one edit apart, by a positional q-gram index.

Counting.  `word_counts` adds up runs of letters; each task counts its documents' words first.

Dealing the index.  One insertion, deletion or replacement leaves one half of a word as it is, at its
start or its end.  Each word is posted under both halves, as positional grams of that length, together
with a length limit: for words as long as itself, for words one longer, and, by the halves that a word
one shorter would have, for those.  Near words thus meet in a group of one limit, side and half.

Count filter.  Each group holds an inverted index of the positional bigrams of its words.  A word of L
code points has L - 1 of them and an edit touches at most two, so a near word that is no longer shares at
least L - 3, at the same position or, if it is shorter, up to one before.  The words are taken in turn:
as any three of a word's bigrams hold one that is shared, the postings of its three shortest lists are
merged by a heap, each candidate's bigrams are counted, and those below the bound are left.  The rest
are verified by the words themselves.

Hot groups.  Where more than GROUP words meet in one group, they are dealt on by their one-deletion
variants: near words of one length share one, and the shorter of two lengths is one.  A variant of m
code points has at most (m + 1) * (letters) words, so these groups are bounded and nothing is dropped.

`near_pairs` gives each pair of near words once.  `forms` takes the most frequent near word with at
least RATIO times the count, and follows such steps to the root by doubling.  Each step multiplies the
count by RATIO, so a count of 64 bits has 18 steps at most, which five doublings cover.

Cases: a null or empty text has no words; a null doc_id counts as an empty string in the hash; a
very long text is read whole; repeated rows count each; of forms of equal count the smallest in
code-point order is taken; words need no partner and stay with n_near 0; an empty table gives no
rows.  Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words have at least so many code points and occurrences.
SHORTEST, LEAST = 7, 2
#: A form has at least so many times the count of its variant.
RATIO = 10
#: Words of one group of the index that a task holds at once; larger groups are dealt on, whole.
GROUP = 2_000
#: Bigrams that one edit can touch.
TOUCHED = 2
#: Words whose counts a task holds before it passes them on.
HELD_WORDS = 300_000

PAIRS = "a string, b string"
_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string())])
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
#: Fixed value: the letters of a word.
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, typo_every: int = 31) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, with at least `shortest` code points and `least` occurrences.

    Let h be the CRC-32 of `<doc_id>:<run>`.  Where `typo_every` divides h, the run's code point h modulo its
    length is left out; 0 leaves all runs as they are.
    """
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # the bytes' lower() knows A-Z only
                for run, n in Counter(runs(text.encode().lower().decode())).items():
                    if typo_every and (h := zlib.crc32(run.encode(), start)) % typo_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _bigrams(word: str) -> list[tuple[str, str, int]]:
    """Positional bigrams."""
    return list(zip(word, word[1:], count()))


def _bigrams_before(word: str) -> list[tuple[str, str, int]]:
    """The bigrams, each one place before: where a word has them that lacks a code point further to the left."""
    return list(zip(word, word[1:], count(-1)))


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_in_group(words: list[str], apart: int | None = None) -> list[tuple[str, str]]:
    """The near pairs among distinct words: postings merged by a heap, counts held against the bound, the rest verified.

    apart: 0 where all words are of one length; 1 for pairs of two lengths only; None for all.  Words are taken
    by length, so that each meets those before it, which are no longer than itself.
    """
    words = sorted(words, key=lambda w: (len(w), w))
    index: dict[tuple[str, str, int], list[int]] = defaultdict(list)
    grams, found = [], []
    for number, word in enumerate(words):
        own = _bigrams(word)
        later = apart == 1 and len(word) > len(words[0])
        if later or apart != 1:
            reach = own if apart == 0 else own + _bigrams_before(word)
            lists = list(map(index.get, reach, repeat(())))
            if apart != 0:  # a bigram's two places are one list
                lists = list(zip(lists, lists[len(own) :]))
                lists.sort(key=lambda two: len(two[0]) + len(two[1]))
                heads = chain.from_iterable(lists[: TOUCHED + 1])
            else:
                lists.sort(key=len)
                heads = lists[: TOUCHED + 1]
            reached, bound, before = set(reach), len(own) - TOUCHED, -1
            for other in heapq.merge(*filter(None, heads)):
                if other != before:
                    before = other
                    if len(reached & grams[other]) >= bound and one_edit(words[other], word):
                        found.append((words[other], word))
        if not later:
            grams.append(set(own))
            for key in own:
                index[key].append(number)
    return found


def _pairs_of(groups: pa.Array, apart: pa.Array) -> pa.RecordBatch:
    """Near pairs of an array of groups."""
    pairs = list(chain.from_iterable(map(near_in_group, groups.to_pylist(), apart.to_pylist())))
    return pa.RecordBatch.from_arrays([pa.array([p[side] for p in pairs], pa.string()) for side in (0, 1)], schema=_PAIRS)


def _posted(words: DataFrame) -> DataFrame:
    """word, limit, side, half: each word under its halves, for each of the three lengths of a partner.

    limit: the sum of both lengths.
    """
    long = F.length("word")

    def halves(limit, size):
        """Both halves that a word of `size` code points would share with this one."""
        first = F.floor(size / 2).cast("int")
        rest = size - first
        side = lambda n, half: F.struct(limit.alias("limit"), F.lit(n).alias("side"), half.alias("half"))
        return side(0, F.substring("word", F.lit(1), first)), side(1, F.substring("word", long - rest + 1, rest))

    posts = F.array(*halves(2 * long, long), *halves(2 * long + 1, long), *halves(2 * long - 1, long - 1))
    return words.select("word", F.explode(posts).alias("p")).select("word", "p.limit", "p.side", "p.half")


def near_pairs(words: DataFrame, most: int = GROUP) -> DataFrame:
    """a, b: each pair of near words among distinct words(word) once, a being the shorter or, of equal length, the lesser.

    `words` is read more than once, so it should be a written table; words have at least four code points.
    """
    key = ["limit", "side", "half"]
    posted = _posted(words.select("word"))
    hot = cut(posted.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select(*key))
    groups = posted.join(hot, key, "left_anti").groupBy(*key).agg(F.collect_list("word").alias("words"))
    # a word without partner is none's; words of different length meet where the limit is odd
    lengths = F.transform("words", lambda w: F.length(w))
    groups = groups.where((F.size("words") > 1) & ((F.col("limit") % 2 == 0) | (F.array_min(lengths) < F.array_max(lengths))))
    # beyond `most` words: each word's variants, and the word itself, which may be a longer one's variant
    again = posted.join(hot, key, "left_semi").select("word").distinct()
    cuttings = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))),
    )
    dealt = again.select("word", F.explode(F.array_distinct(F.concat(cuttings, F.array("word")))).alias("variant"))
    bounded = dealt.groupBy("variant").agg(F.collect_list("word").alias("words")).where(F.size("words") > 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pairs_of(batch.column(0), batch.column(1))

    both = groups.select("words", (F.col("limit") % 2).alias("apart")).unionByName(bounded.select("words", F.lit(None).cast("int").alias("apart")))
    return both.mapInArrow(found, PAIRS).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each of words(word, n), which is read more than once.

    pairs(a, b) has each near pair once.  The ratio is over 1, else steps might run in circles.
    """
    if ratio <= 1:
        raise ValueError("a form needs a higher count than its variant")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # of equal counts the smallest word: strings are ordered by their UTF-8 bytes, which is code-point order
    best = F.min_by("other", F.struct(-F.col("other_n"), F.col("other")))
    near = sides.join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("other_n").alias("best_n"))
    met = words.select("word", "n").join(near, "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    told = cut(
        met.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best")).alias("form"),
            F.when(fits, F.col("best_n")).alias("form_n"),
        )
    )
    steps = told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    while True:
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        longer = cut(steps.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        steps = longer.select("word", "to")
        if not longer.where("moved").limit(1).count():
            break
    roots = steps.withColumnRenamed("to", "root")
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Words of docs(doc_id, text) with their most frequent form and root: word, form, root, n, n_near, form_n."""
    words = cut(word_counts(docs))
    return forms(words, near_pairs(words))
