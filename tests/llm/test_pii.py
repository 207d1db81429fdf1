"""Personal data: the patterns against plain regular expressions, the field against brute force and held-out examples."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tallgrass.llm import pii, queries

DOC = "doc_id long, text string, spans string, kind int"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    """The contract's patterns, word for word."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_equal_the_plain_patterns():
    rnd, hits = random.Random(5), 0
    for letters, size in (("ab@@..-1 ", 30), ("0123456789. -", 60), ("255.01", 40), ("+1 (02).-+x", 40), ("4", 20), ("a.@b1+é٣\n", 25)):
        for _ in range(3000):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, size)))
            assert pii.base_spans(text) == plain_spans(text), text
            hits += len(plain_spans(text))
    assert hits > 500
    for text in ("a@b.c@d.e", "@@a@b.c", "x@y z@w.v", "1.2.3.4.5.6.7.8.9", "300.1.1.1 1.1.1.1", "4111111111111111", "4111 1111 1111 1111-", "+1 (184) 555-7766)"):
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("run", ["1", "a", ".", "1.", "@", "+1", "1 ", "dot ", "+1("])
def test_very_long_runs_take_linear_time(run, field):
    text = run * (400_000 // len(run))
    assert not any(s[0] == "email" for s in pii.base_spans(text))
    pii.added_spans([text[:60_000]], [[]], field)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled(spark))


def test_held_out_examples(spark, field):
    """Numbers, names and words of another seed; spans that the validity of a form allows."""
    right = wrong = missed = 0
    for r in pii.labelled(spark, rounds=3, seed=99).collect():
        text = r["text"]
        want = {(s["kind"], s["start"], s["end"]) for s in r["spans"] if pii._valid(s["kind"], text[s["start"] : s["end"]])}
        got = set(pii.added_spans([text], [[]], field)[0])
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 100 and wrong <= 0.03 * right and missed <= 0.05 * right


@pytest.mark.parametrize(
    "text, want",
    [
        ("Please call 555-010-4477 tomorrow.", [("phone", "555-010-4477")]),
        ("Tel: (030) 1234567 / Fax 030 7654321", [("phone", "(030) 1234567"), ("phone", "030 7654321")]),
        ("mail lena (at) firma (punkt) de", [("email", "lena (at) firma (punkt) de")]),
        ("his card is 4111.1111.1111.1111 since May", [("card", "4111.1111.1111.1111")]),
        ("his card is 4111.1111.1111.1112 since May", []),  # no card by its digits
        ("host 10[.]0[.]0[.]1 is down", [("ip", "10[.]0[.]0[.]1")]),
        ("Meeting on 2021-03-04 at 10:30 in room 12, version 1.2.3, call me at 5", []),
        ("It cost $1,299.00 in 2019, see pages 120-134 and chapter 3.2.1", []),
        ("the dot at the end. Look at example.com, ISBN 978-3-16-148410-0", []),
    ],
)
def test_added_spans(field, text, want):
    assert [(k, text[s:e]) for k, s, e in pii.added_spans([text], [[]], field)[0]] == want


def test_added_spans_leave_base_spans_alone(field):
    text = "call 555-010-4477 or +1 (184) 555-7766"
    base = pii.base_spans(text)
    assert [text[s:e] for _, s, e in base] == ["+1 (184) 555-7766"]
    assert [text[s:e] for _, s, e in pii.added_spans([text], [base], field)[0]] == ["555-010-4477"]


def test_texts_of_a_batch_do_not_see_each_other(field):
    texts = ["call", "555-010-4477", "at mail dot org", "anna", "", "call 555-010-4477"]
    alone = [pii.added_spans([t], [[]], field)[0] for t in texts]
    assert pii.added_spans(texts, [[]] * len(texts), field) == alone


def random_field(seed):
    rnd = np.random.default_rng(seed)
    field = pii.Field(["digits 2", "lower", "glued", "sign @", "= dot"], rnd.normal(size=(5, 5, 3)), rnd.normal(size=(3, 3)))
    return field, rnd


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_all_labellings(seed):
    field, rnd = random_field(seed)
    flat = [["12", " abc", "@", " dot", "x"][i] for i in rnd.integers(0, 5, 60)]
    classes = field.classes(flat)
    allowed = rnd.random(60) < 0.7
    allowed[::8] = False
    got = field.decode(classes, allowed)
    emit = field.emissions(classes, np.arange(60))
    at = 0
    while at < 60:
        end = at
        while end < 60 and allowed[end]:
            end += 1
        if end > at:
            def score(path):
                return sum(emit[at + i, y] for i, y in enumerate(path)) + sum(field.steps[a, b] for a, b in zip((0, *path), (*path, 0)))

            best = max(itertools.product(range(3), repeat=end - at), key=score)
            assert tuple(got[at:end]) == best
        at = end + 1
    assert not got[~allowed].any()


def test_expected_counts_equal_sums_over_all_labellings():
    rnd = np.random.default_rng(3)
    emit, steps = rnd.normal(size=(2, 4, 3)), rnd.normal(size=(3, 3))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    expected, pairs = pii._expected(emit, steps, real)
    want_pairs = np.zeros((3, 3))
    for row, size in ((0, 4), (1, 2)):
        paths = list(itertools.product(range(3), repeat=size))
        weights = np.array([np.exp(sum(emit[row, i, y] for i, y in enumerate(p)) + sum(steps[a, b] for a, b in zip((0, *p), (*p, 0)))) for p in paths])
        weights /= weights.sum()
        for p, w in zip(paths, weights):
            for a, b in zip((0, *p), (*p, 0)):
                want_pairs[a, b] += w
        for i in range(size):
            assert np.allclose(expected[row, i], [sum(w for p, w in zip(paths, weights) if p[i] == y) for y in range(3)])
    assert np.allclose(pairs, want_pairs)


def test_cases(spark, field):
    long = "word " * 100_000 + "a@b.de call 555-010-4477"
    rows = [(1, None), (2, ""), (3, long), (None, "x@y.zz"), (4, "1.2.3.4"), (4, "1.2.3.4"), (5, "clean text, nothing else")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.digests(pii.personal_data(docs, field)).collect()), key=repr)
    want = [(1, ""), (2, ""), (3, f"email:500000:500006,phone:{len(long) - 12}:{len(long)}"), (None, "email:0:6"), (4, "ip:0:7"), (4, "ip:0:7"), (5, "")]
    assert got == sorted(want, key=repr)
    assert pii.personal_data(docs.where("doc_id = 99"), field).count() == 0
    none = spark.createDataFrame([], "text string, spans array<struct<kind:string,start:int,end:int>>")
    empty = pii.fit(none)
    assert pii.added_spans([long], [[]], empty) == [[]]


def test_query_equals_plain_patterns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.queries()["op11_pii"](spark, folder)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        told = [":".join(map(str, s)) for s in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) | {""}
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in r["spans"].split(",") if s]
        assert order == sorted(order)
