"""Operator 1 against the tiktoken library."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallgrass.llm import bpe
from tallgrass.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.read_ranks(PATH), PATTERN)


def test_random_texts(ours, library):
    rnd = random.Random(1)
    close = " \t\n\x1c\x85\xa0aàßéñ’'s're'LL12²½٣Ⅷ中国日本🎉👨‍👩‍👧 --==__..​ "
    for k in range(3000):
        text = "".join(rnd.choice(close) if k % 2 else chr(rnd.randint(0, 0x2FFF)) for _ in range(rnd.randint(0, 60)))
        ids = ours.encode(text)
        assert ids == library.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 50_000, "ab" * 20_000, " " * 50_000, "<|endoftext|>", "é" * 9_999])
def test_extreme_texts(ours, library, text):
    assert ours.encode(text) == library.encode_ordinary(text)


def test_query_columns(spark, library):
    rows = [(1, "Hello  world", 7), (2, None, 7), (3, "", 7), (1, "Hello  world", 7), (4, "naïve 🎉\n\n x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == sorted(
        (i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows
    )
    assert {r.doc_id: r.n_tokens for r in bpe.digests(bpe.round_trip(docs, PATH, PATTERN)).collect()}[2] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.round_trip(docs, PATH, PATTERN)).collect() == []


def test_a_variant_is_counted_with_what_its_text_gave(monkeypatch):
    texts = [" ".join(f"piece{i}x{k}" for k in range(40)) for i in range(30)]
    variants = [t.replace(" ", "  ", 5) for t in texts]
    one = bpe.Bpe(bpe.read_ranks(PATH), PATTERN)
    one.counts.room = 60  # less than all texts have, more than one has
    made, own = [], one.encode_piece
    monkeypatch.setattr(one, "encode_piece", lambda piece: made.append(piece) or own(piece))
    found = [(one.count(a), one.count(b)) for a, b in zip(texts, variants)]
    assert len(made) < 1.2 * len(set(made))  # all texts first and then all variants: twice as many
    assert found == [(len(one.encode(a)), len(one.encode(b))) for a, b in zip(texts, variants)]


def test_counts_of_variants(spark, library):
    rows = [(1, "a  b", "a b"), (2, None, ""), (3, "same", "same"), (4, "x\n\ny" * 50, "x y" * 50), (5, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = {r[0]: r[1] for r in frame.select("doc_id", bpe.count_variants(F.col("text"), F.col("other"), PATH, PATTERN)).collect()}
    n = lambda t: len(library.encode_ordinary(t or ""))
    assert {i: (r.own, r.variant) for i, r in got.items()} == {
        i: (n(a), None if (a or "") == (b or "") else n(b)) for i, a, b in rows
    }
