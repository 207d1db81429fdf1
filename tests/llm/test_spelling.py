"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tallgrass.llm import queries, spelling
from tallgrass.llm.common import cut

DOC = "doc_id long, text string, word string, n int"


def brute(rows):
    """word, form, root, n, n_near, form_n by comparing all pairs that a deletion brings together."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    holes = {}
    for w in n:
        for key in {(w[:i] + w[i + 1 :]) for i in range(len(w))} | {w}:
            holes.setdefault(key, []).append(w)
    near = {w: set() for w in n}
    for group in holes.values():
        for a, b in combinations(group, 2):
            same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
            s, t = sorted((a, b), key=len)
            if same or (len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def texts(seed):
    """Texts of words that are often one or two edits apart, some of them common."""
    rnd = random.Random(seed)
    letters = "abé×Z"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12))) for _ in range(40)]
    bag = []
    for w in base:
        for steps in range(rnd.randint(0, 6)):
            v = w
            for _ in range(rnd.choice([0, 1, 1, 2])):
                i = rnd.randrange(len(v))
                v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice(letters) + v[i:], v[:i] + rnd.choice(letters) + v[i + 1 :]])
            bag += [v] * rnd.choice([1, 2, 3, 25, 300])
    rnd.shuffle(bag)
    rows = [(i, rnd.choice([" ", "-", "\n", "9"]).join(bag[k : k + 50])) for i, k in enumerate(range(0, len(bag), 50))]
    return [*rows, (7, None), (8, ""), (None, "wordlike wordlike wordlikes wordlikes " * 12), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)
    want = brute(rows)
    assert sum(f is not None for f, *_ in want.values()) > 10
    assert got_of(spelling.variants(df)) == want


@pytest.mark.parametrize("most", [2, 5, 10_000])
def test_hot_groups_are_dealt_on_whole(spark, most):
    """All words share their start; groups beyond the bound lose no pair, and none comes twice."""
    rnd = random.Random(most)
    words = {"start" + "".join(rnd.choice("ab") for _ in range(rnd.randint(3, 7))) for _ in range(150)}
    df = cut(spark.createDataFrame([(w,) for w in words], "word string"))
    want = {tuple(sorted(p, key=lambda w: (len(w), w))) for p in combinations(words, 2) if spelling.one_edit(*p)}
    got = [tuple(r) for r in spelling.near_pairs(df, most).collect()]
    assert set(got) == want and len(got) == len(want)


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    words = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    pairs = spark.createDataFrame(list(zip(chain, chain[1:])), "a string, b string")
    got = got_of(spelling.forms(words, pairs))
    assert {w: (f, r) for w, (f, r, *_) in got.items()} == {w: (f, chain[-1]) for w, f in zip(chain, [*chain[1:], None])}
    with pytest.raises(ValueError):
        spelling.forms(words, pairs, ratio=1)


def test_very_long_text_and_empty_table(spark):
    long = "ordinary " * 200_000 + "ordinari " * 20_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert got_of(spelling.variants(df)) == brute([(1, long)])
    assert spelling.variants(df.where("doc_id = 2")).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.queries()["op12_spelling"](spark, folder)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got_of(found) == brute(docs)
