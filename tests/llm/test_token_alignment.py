"""Alignment of two tokenizers against brute force with both libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallgrass.llm import queries, token_alignment

DOC = "doc_id long, text string, groups string, a int"
PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(rows, libraries):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each of the rows, by sets of ends."""
    a_library, b_library = libraries
    byte_of = token_alignment.byte_of_symbol()
    spelled = {i: bytes(byte_of[c] for c in t) for t, i in a_library.get_vocab(False).items() if i < 50256}

    def piece(i):
        p = b_library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found = []
    for _, text in rows:
        a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(map(spelled.get, a)) != raw or b"".join(map(piece, b)) != raw:
            found.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(spelled[i]) for i in a]), np.cumsum([len(piece(i)) for i in b])
        groups, links, done_a, done_b = [], [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            to_a, to_b = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append("|".join(",".join(map(str, ids)) for ids in (a[done_a:to_a], b[done_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            done_a, done_b = to_a, to_b
        if len(a) < 60:
            assert sorted(links) == sorted((i, j) for i, e in zip(a, ends_a) for j, f in zip(b, ends_b) if e == f)
        found.append((len(a), len(b), groups, links))
    counts = Counter(link for *_, links in found for link in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (a, b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        for a, b, groups, links in found
    ]


def told(df):
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best_b", "count_sum"]
    return sorted(((r["doc_id"], *(r[n] for n in names), r["groups"]) for r in df.withColumn("groups", digest).collect()), key=repr)


def expected(rows, libraries):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return sorted(((i, *own[:-1], sha(own[-1])) for (i, _), own in zip(rows, brute(rows, libraries))), key=repr)


def odd_rows():
    rnd = random.Random(3)
    bits = ["the", "The", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "1234", "don't", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "▁", " ", "\x00", "ﬁ", "é", "…", "\r\n"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    return [*rows, (900, None), (901, ""), (902, " "), (None, "no id"), (903, "twice"), (903, "twice"), (904, " lead and trail ")]


def test_alignment(spark, libraries):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)
    aligned = token_alignment.align(docs, *PATHS)
    assert aligned.schema["doc_id"].dataType.typeName() == "long"
    want = expected(rows, libraries)
    assert any(w[1] == 0 and w[0] is not None and w[0] < 900 for w in want)  # texts whose pieces don't spell them
    assert told(token_alignment.scored(aligned)) == want
    # beyond the bound of a broadcast: hot pairs by broadcast, others by exchange
    assert told(token_alignment.scored(aligned, most=3)) == want


def test_hot_pairs_are_told_apart(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "HOT_SHARE", 4)
    rows = [(i, "the the the " * i + f"cat number {i}") for i in range(1, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(token_alignment.scored(token_alignment.align(docs, *PATHS), most=3)) == expected(rows, libraries)


def test_very_long_texts_and_runs(spark, libraries):
    rows = [(1, "word after word " * 20_000), (2, "a" * 30_000), (3, "x" + " " * 20_000 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.align(docs, *PATHS).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        a = libraries[0].encode(" " + text, add_special_tokens=False).ids
        b = libraries[1].encode(text)
        told_a = [int(i) for g in r["groups"].split(";") for i in g.split("|")[0].split(",")]
        told_b = [int(i) for g in r["groups"].split(";") for i in g.split("|")[1].split(",")]
        assert (told_a, told_b) == (a, b) and r["n_groups"] == sum(r["links"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert token_alignment.scored(token_alignment.align(docs, *PATHS)).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)], DOC)
    assert told(token_alignment.scored(token_alignment.align(nulls, *PATHS))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_both_encoders_give_the_same_ids(libraries):
    side = token_alignment.ByteLevel(PATHS[0])
    assert side.by_rank is not None
    for _, text in odd_rows():
        if text:
            assert side.ids([text])[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.queries()["op13_token_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows, libraries)
