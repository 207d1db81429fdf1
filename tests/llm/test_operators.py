"""Operators against brute force on small tables, with the odd cases each of them defines."""

import hashlib
import html
import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallgrass.llm import (
    components,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    near_dedup,
    sharding,
    suffix_dedup,
    token_rollup,
    url_filter,
)
from tallgrass.llm.common import cut_and_tell, not_kept, without
from tallgrass.llm.queries import URL_RULES

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash") for i, t in texts], DOC)


def words(rnd, n, size=400):
    return [f"w{rnd.randint(0, size)}" for _ in range(n)]


# ---- near-duplicates ----


def brute_classes(texts):
    norm = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        norm[i] = (w, t or "")
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(norm, 2):
        (wa, ta), (wb, tb) = norm[a], norm[b]
        if wa and wb:
            sa, sb = ([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] for w in (wa, wb))
            best = [0] * (len(sb) + 1)
            for x in sa:
                before = best[:]
                for j, y in enumerate(sb):
                    best[j + 1] = before[j] + 1 if x == y else max(before[j + 1], best[j])
            near = best[-1] / (len(sa) + len(sb) - best[-1]) >= 0.8
        else:
            near = not wa and not wb and ta == tb
        if near:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in norm}


def test_near_dedup(spark):
    rnd = random.Random(4)
    texts, n = [], 0
    for _ in range(12):
        base = words(rnd, rnd.randint(30, 200))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], ["new"], [copy[at], "more"]])
            texts.append((n, " ".join(copy)))
            n += 1
    texts += [(100, None), (101, ""), (102, "!!"), (103, "!!"), (104, "??"), (105, "one two"), (106, "One, two."), (107, "a " * 3000)]
    texts += [texts[0]]
    got = near_dedup.near_groups(docs_of(spark, texts)).collect()
    expected = brute_classes(texts)
    assert len(got) == len(texts)
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    sizes = Counter(expected[i] for i, _ in texts)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_near_dedup_in_one_large_group(spark):
    """Copies of one text with so many edits that some are linked, some only through others, some not."""
    rnd = random.Random(11)
    base, texts = words(rnd, 90), []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.randint(1, 6)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 10**6)}"
        texts.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert got == brute_classes(texts)
    assert 1 < len(set(got.values())) < 60


def test_near_dedup_empty(spark):
    assert near_dedup.near_groups(docs_of(spark, [])).collect() == []


def test_alignment_is_the_longest_common_subsequence():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(300):
        a = np.array([rnd.randint(0, 12) for _ in range(rnd.randint(1, 30))], np.uint64)
        b = np.array([x for x in a.tolist() if rnd.random() < 0.9] + [rnd.randint(0, 12)], np.uint64)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in ((i, j) for i in range(len(a)) for j in range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for need in range(1, len(a) + 1):
            assert (near_dedup.aligned(a, b, need) >= need) == (best[-1][-1] >= need)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in link for link in links if link[0] != link[1])}


# ---- urls ----


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "http://b.net/fr/#x", "b.net", "/fr/", "net/fr/", "block"),
        (4, "http://b.net/de/", "b.net", "/de/", None, "allow"),
        (5, None, "", "", None, "allow"),
        (6, "b.net/es/", "", "", None, "allow"),
        (7, "x://com?y://z", "com", "", None, "allow"),
        (8, "http://notcom/", "notcom", "/", None, "allow"),
        (9, "http://ÄB.com/", "Äb.com", "/", "com/", "allow"),
        (10, "", "", "", None, "allow"),
        (11, "http://b.net/fra/", "b.net", "/fra/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u, *_ in urls], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    for i, _, host, path, rule, verdict in urls:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), i


def test_link_graph_against_brute_force(spark):
    rnd = random.Random(3)
    hosts = [f"h{i}.org" for i in range(12)] + ["bad.net", "worse.net", "good.com"]
    pages = []
    for i in range(120):
        host = rnd.choice(hosts)
        path = "/es/" if host.endswith(".net") else "/x"
        links = "".join(f'<a class="q" href="{rnd.choice(["http:", ""])}//{rnd.choice(hosts)}/p">x</a><a href="/own">y</a>' for _ in range(3))
        pages.append((i, f"http://{host}{path}", links))
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    weight = Counter()
    for _, url, page in pages:
        source = url.split("/")[2]
        weight.update((source, t) for t in re.findall(r"//([^/]+)/p", page) if t != source)

    def rank(edges, seed):
        out = Counter()
        for (s, _), w in edges.items():
            out[s] += w
        score = dict(seed)
        for _ in range(url_filter.ROUNDS):
            after = Counter(seed)
            for (s, t), w in edges.items():
                after[t] += 0.85 * score.get(s, 0.0) * w / out[s]
            moved, score = max(abs(after[h] - score.get(h, 0.0)) for h in after), after
            if moved < url_filter.TOLERANCE:
                break
        return score

    present = {u.split("/")[2] for _, u, _ in pages}
    trust = rank(weight, {h: 0.15 for h in present if h.endswith(".com")})
    distrust = rank({(t, s): w for (s, t), w in weight.items()}, {h: 0.15 for h in present if h.endswith(".net")})
    for r in got:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0.0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0.0))
        if r["rule"] is None:
            bad = r["distrust"] >= 0.075 and r["distrust"] > r["trust"]
            assert r["verdict"] == ("block" if bad else "allow")


def test_distrust_in_a_cycle_is_followed_to_its_end(spark):
    pages = [(0, "http://bad.net/es/", '<a href="//b.org/">x</a>'), *((i, "http://bad.net/x", "") for i in range(1, 6)), (6, "http://b.org/x", '<a href="//bad.net/">x</a>')]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [("block", "bad.net", "/es/")]).collect()}
    limit = 0.15 / 6 * 0.85 / (1 - 0.85**2)  # of the endless sum; a little over the threshold
    assert 0.075 < limit < 0.077
    assert got[6]["distrust"] == pytest.approx(limit, abs=1e-5) and got[6]["verdict"] == "block"


# ---- exact copies ----


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(spark, digest_all):
    texts = [(5, "a b"), (3, "a\t\r\n b"), (9, None), (8, ""), (7, "x"), (4, " x"), (6, "b a"), (2, "q" * 300 + "1"), (1, "q" * 300 + "2"), (7, "x")]
    got = exact_dedup.exact_groups(docs_of(spark, texts), digest_all).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    assert len(got) == len(texts)
    for r in got:
        own = [i for i, t in texts if norm[i] == norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
        if digest_all:
            assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.exact_groups(docs_of(spark, []), digest_all).collect() == []


def test_without(spark):
    docs = docs_of(spark, [(1, "a"), (2, "b"), (None, "c")])
    gone = not_kept(spark.createDataFrame([(1, True), (1, False), (2, False)], "doc_id long, kept boolean"))
    left = without(docs, gone)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, None}


# ---- shards ----


def test_shards(spark):
    rnd = random.Random(6)
    texts = [(i, "x" * rnd.choice([0, 3, 50, 400, 2_000]) + str(rnd.randint(0, 150))) for i in range(600)] + [(600, None), (601, ""), (5, "same id")]
    got = sharding.shards(docs_of(spark, texts), 7).collect()
    assert len(got) == len(texts)
    place = {}
    for r, t in zip(sorted(got, key=lambda r: (r["doc_id"], r["size"])), sorted(texts, key=lambda x: (x[0], len(x[1] or "")))):
        assert place.setdefault(t[1] or "", r["shard"]) == r["shard"]
        assert r["size"] == len(t[1] or "") + 16 and r["grown_shard"] is None and r["law"] == "bytes"
    sizes = Counter()
    for s in range(7):
        own = [r for r in got if r["shard"] == s]
        sizes[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 7
    assert sharding.shards(docs_of(spark, []), 7).collect() == []


def test_differencing():
    import numpy as np

    assert sorted(np.bincount(sharding.partition(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert sharding.partition(np.array([], np.int64), 3).tolist() == []


# ---- languages ----


def test_language_id(spark):
    rnd = random.Random(8)
    made = {"xx": "aeiou", "yy": "bcdfg", "zz": "ñéüßø"}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(made))
        rows.append((i, " ".join("".join(rnd.choice(made[lang]) for _ in range(5)) for _ in range(30)), lang))
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "xx"), (1003, "aeiou " * 20_000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows[:300])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert all(got[i]["rejected"] for i in (1000, 1001, 1002)) and all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_cut_decides_where_nothing_is_named():
    """Short blocks go with what stands beside them, against the sign of their own costs."""
    import numpy as np

    long = "This sentence of a paragraph goes on for some more words. Another one follows it at once."
    menu = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(4))
    page = f"<div><ul>{menu}<li>News of the whole week and of the day</li>{menu}</ul></div><div><p>{long}</p><p>Two</p><p>{long}</p></div>"
    found = html_text.blocks(page)
    assert all(b.says == 0 for b in found)
    cost, other = html_text.costs(found, html_text.PRIOR)
    signs = [b.text for b, c, o in zip(found, cost, other) if c > o]
    assert signs == ["News of the whole week and of the day", long, long]
    assert html_text.main_text(page, np.array(html_text.PRIOR)) == f"{long}\n\nTwo\n\n{long}"


def test_names_of_outer_elements_do_not_hide_an_article():
    long = "This sentence of a paragraph goes on for some more words. Another one follows it at once."
    article = "".join(f"<p>{long}</p>" for _ in range(5))
    rest = f'<nav><a href="/">Home</a></nav><div class="comments"><p>{long}</p></div><footer>Some one.</footer>'
    for head, tail in (
        ('<body class="home has-sidebar"><div>', "</div></body>"),
        ('<body class="page header-fixed"><article>', "</article></body>"),
        ('<body><article class="post category-social">', "</article></body>"),
        ('<div class="page header-fixed"><article>', "</article></div>"),
        ("<form><article>", "</article>"),
    ):
        page = f"<html>{head}{article}{rest}{tail}</html>"
        assert html_text.main_text(page, html_text.PRIOR) == "\n\n".join([long] * 5), head
    linked = html_text.blocks("<a href=x><div>all of it</div></a>")
    assert [(b.text, b.linked) for b in linked] == [("all of it", 9)]


def test_null_ids(spark):
    """Rows of null doc_id have their part in every decision, and no decision is null."""
    texts = [(None, "a b c d e f g"), (1, "a b c d e f g"), (None, "x y z"), (None, "x y z"), (2, "q")]
    docs = docs_of(spark, texts)
    got = [(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs, digest_all=True).collect()]
    expected = [(None, 1, False), (1, 1, True), (None, None, True), (None, None, True), (2, 2, True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r["held_out"] for r in language_id.identify(docs).where("doc_id IS NULL").collect()} == {False}
    gone = spark.createDataFrame([(None,), (2,)], "doc_id long")
    assert [r["doc_id"] for r in without(docs, gone).collect()] == [1]


def test_alien_texts_are_rejected(spark):
    docs = docs_of(spark, [(i, f"the cat number {i} sat on the mat and looked at the dog") for i in range(60)])
    model = language_id.fit(docs)
    assert model.predict("日本語の文章です。漢字と仮名。")[2] and not model.predict("the dog sat on the cat")[2]


# ---- repeated strings ----


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((kept, len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(30, 90))) for _ in range(5)]
    texts = []
    for i in range(60):
        parts = [rnd.choice(passages)[rnd.randint(0, 8) :] if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 80))) for _ in range(rnd.randint(0, 8))]
        texts.append("".join(parts))
    texts += [texts[3], None, "", "z" * 500, "ab" * 200, "short"]
    raw = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(docs_of(spark, list(enumerate(texts))), 40).collect()}
    assert len(got) == len(texts)
    for i, (kept, spans) in enumerate(brute_repeats(raw, 40)):
        assert (bytes(got[i]["kept"]), len(got[i]["spans"]), got[i]["n_bytes"]) == (kept, spans, len(raw[i])), i
        assert b"".join(raw[i][s["start"] : s["end"]] for s in got[i]["spans"]).__len__() == len(raw[i]) - len(kept)
    assert suffix_dedup.repeats(docs_of(spark, []), 40).collect() == []


def test_suffix_index_memory():
    """What a core holds for its index doesn't grow with what it is given."""
    rnd = random.Random(5)
    rows = [(k // 8, 1, k, k, 0, rnd.randbytes(280).replace(b"\0", b"a")) for k in range(16_000)]  # 4.5 MB
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, names=["anchor", "n", "doc_id", "text_key", "start", "bytes"])
    tracemalloc.start()
    for _ in suffix_dedup._indexed(200)(batch.slice(at, 1000) for at in range(0, len(rows), 1000)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


@pytest.mark.parametrize("hot", [10_000, 0])
def test_suffix_dedup_with_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(4)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(3)]
    other = lambda: "".join(rnd.choice("stuvwxyz") for _ in range(60))
    rows = [(None, passages[0] + other()), (1, other() + passages[0][20:] + other()), (None, passages[1]), (None, passages[1]), (0, passages[2] + other() + passages[2]), (None, "")]
    raw = [t.encode() for _, t in rows]
    got = suffix_dedup.repeats(docs_of(spark, rows), 40).collect()
    expected = [(i, len(b), kept) for (i, _), b, (kept, _) in zip(rows, raw, brute_repeats(raw, 40))]
    assert any(i is None and len(kept) < n for i, n, kept in expected)
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got), key=repr) == sorted(expected, key=repr)


def test_matching_statistics():
    rnd = random.Random(5)
    for _ in range(60):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 5))]
        index = suffix_dedup.RunIndex(strings)
        places = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]
        told = index.matching_statistics()
        for i, j in places:
            common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            best = max((common(strings[i][j:], strings[a][b:]) for a, b in places if (a, b) != (i, j)), default=0)
            assert told[index.starts[i] + j] == best


# ---- benchmark ----


def test_decontamination(spark):
    items = [
        (1, "If Alice Smith has 3 apples and gives 2 apples to Bob then how many apples does Alice Smith keep for the week?"),
        (2, "which river crosses the old town between both hills"),
        (3, "two words"),
        (4, None),
    ]
    texts = [
        (1, "Well. If Carol Jones has 17 apples and gives 5 apples to Dan then how many apples does Carol Jones keep for the week? Yes."),
        (2, "Well. If Carol Jones has 17 apples and gives 5 apples to Dan then how many apples does Eve keep for the week? Yes."),
        (3, "x WHICH RIVER CROSSES THE OLD TOWN BETWEEN BOTH HILLS y"),
        (4, "which river crosses the wide plain between both hills"),
        (5, None),
        (6, ""),
        (7, "text " * 5_000 + items[1][1]),
        (8, "IF ALICE SMITH HAS 3 APPLES AND GIVES 2 APPLES TO BOB THEN HOW MANY APPLES DOES ALICE SMITH KEEP FOR THE WEEK?"),
        (3, "x WHICH RIVER CROSSES THE OLD TOWN BETWEEN BOTH HILLS y"),
    ]
    benchmark = spark.createDataFrame([(i, t, 9) for i, t in [*items, items[0]]], "item_id long, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts), benchmark).collect()}
    assert got == {(1, 1), (3, 2), (7, 2), (8, 1)}
    assert decontamination.contaminated(docs_of(spark, []), benchmark).collect() == []
    assert decontamination.contaminated(docs_of(spark, texts), benchmark.where("false")).collect() == []


def test_short_items_in_long_texts(spark):
    items = [(1, "Who painted the Mona Lisa?"), (2, "two words"), (3, "zebra"), (4, "five words are one window")]
    filler = "some more text of other things " * 50
    texts = [
        (1, f"{filler}. Who painted the Mona Lisa? {filler}"),
        (2, f"{filler} two words {filler}"),
        (3, f"{filler} zebra {filler}"),
        (4, f"{filler} two other words and zebras who painted {filler}"),
        (5, "two words"),
        (6, "zebra"),
        (7, f"{filler} five words are one window {filler}"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts), benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 2), (6, 3), (7, 4)}


def test_items_within_sentences(spark):
    items = [(1, "What is the capital of France?"), (2, "Is Paris larger than Rome by day?"), (3, "In Rome how many bridges stand")]
    texts = [
        (1, "Some text. Question: What is the capital of France? An answer."),
        (2, "Some text. Question: What is the capital of Germany? An answer."),
        (3, "they say Berlin is the capital of Germany"),
        (4, "Sample Question: Is Paris larger than Rome by day? An answer."),
        (5, "Sample Question: Is Berlin larger than Munich by day? An answer."),
        (6, "Sample Question: Was Berlin larger than Munich by day? An answer."),
        (7, "Question 7 In Rome how many bridges stand there"),
        (8, "WHAT IS THE CAPITAL OF FRANCE"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts), benchmark).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (8, 1)}


def test_other_names_and_numbers(spark):
    """Items with other names, also where sentences open, and other numbers, also spelled ones."""
    rnd = random.Random(6)
    people, numbers = "Alice Bob Carol Dan Erin Frank".split(), "three four 7 12 nine 2.5 ten 40".split()
    things = "apples pens books coins shells cards".split()
    shapes = [
        "{a} has {x} {t} and eats {y} daily",
        "{a} buys {x} {t} for {b}. How many {t} does {a} keep if {b} gives back {y} of them?",
        "{a} and {b} share {x} {t} equally after losing {y} on the road",
    ]

    def made(shape, thing):
        (a, b), (x, y) = rnd.sample(people, 2), rnd.sample(numbers, 2)
        return shape.format(a=a, b=b, x=x, y=y, t=thing)

    kinds = [(shape, thing) for shape in shapes for thing in things]
    items = [(i, made(*kind)) for i, kind in enumerate(kinds)]
    texts = [(10 * i + k, f"Some text. {made(*kind)} More text.") for i, kind in enumerate(kinds) for k in range(4)]
    clean = [(1000 + i, f"Some text. {made(shape, 'lamps').replace('and', 'or').replace('share', 'sell')} More text.") for i, shape in enumerate(shapes)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts + clean), benchmark).collect()}
    expected = {(i, i // 10) for i, _ in texts}
    assert len(got & expected) >= 0.9 * len(expected)
    assert not {i for i, _ in got} & {i for i, _ in clean[2:]}


def test_rounds_are_counted_as_they_are_written(spark, monkeypatch):
    """The driver keeps what it knows of each job, so rounds of links have no jobs beside those that write them."""
    read = []
    own = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda df: read.append(df) or own(df))
    monkeypatch.setattr(DataFrame, "first", lambda df: pytest.fail("a job that reads a table back"))
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 91), (91, 90), (50, 50)], "a long, b long")
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert root == {k: 0 for k in range(31)} | {90: 90, 91: 90}
    rnd = random.Random(8)
    text = words(rnd, 60)
    texts = [(i, " ".join(text[:-1] + [f"x{i}"])) for i in range(12)] + [(20, "one two three")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert got == {i: 0 for i in range(12)} | {20: 20}
    assert len(read) <= 2  # both of the texts that are looked for before the rounds


def test_tables_are_counted_as_they_are_written(spark):
    frame = spark.range(100).where("id % 3 = 0")
    out, told = cut_and_tell(frame, F.count(F.lit(1)), F.sum("id"))
    assert told == (34, 1683) and out.count() == 34
    for none in (frame.where("id < 0"), spark.createDataFrame([], "id long"), frame.where("false")):
        out, told = cut_and_tell(none, F.count(F.lit(1)), F.sum("id"))
        assert told == (0, None) and out.count() == 0


def test_near_dedup_writes_small_tables_in_few_tasks(spark, monkeypatch):
    rng = random.Random(5)
    words = [[f"w{rng.randrange(5_000)}" for _ in range(40)] for _ in range(150)]
    texts = list(enumerate(" ".join(w) for row in words for w in (row, [*row[:-1], "other"])))
    wrote = []

    def noted(df, cut=near_dedup.cut):
        found = cut(df)
        wrote.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(near_dedup, "cut", noted)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_dedup.near_groups(docs_of(spark, texts)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 300 and {r["class_id"] for r in got} == set(range(0, 300, 2))
    assert max(wrote) <= 24


def test_decontamination_tells_tokens_apart_once(monkeypatch):
    text = "Tom Smith has 3.5 km and Anna Lee 20 % of $ 7. Then Bob ran twelve miles to New York."
    forms = (decontamination.AS_NAMES, decontamination.AS_WORDS, decontamination.OPENERS_TOO)
    want = [{"names": n} | w for n in forms for size in (3, 5) for w in decontamination._told(decontamination.template(text, n), None, size)]
    read = []
    monkeypatch.setattr(decontamination, "_LATIN_TOKENS", lambda t, found=decontamination._LATIN_TOKENS: read.append(t) or found(t))
    assert decontamination.in_forms(text, [3, 5], None) == want
    assert read == [text]


def test_templates():
    told = decontamination.template("Tom Smith has 3.5 km and Anna Lee 20 % of $ 7. Then 12 Days").tokens()
    assert [t for t, _ in told] == "tom <name> has <num> <unit> and <name> <num> <unit> of <num> then <num> <unit>".split()
    assert [v for _, v in told if v] == ["smith", "3.5", "km", "anna lee", "20", "%", "7", "12", "days"]


# ---- pages ----


def test_min_cut_against_brute_force():
    rnd = random.Random(2)
    for _ in range(400):
        n = rnd.randint(1, 8)
        c, b = ([rnd.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rnd.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]
        cost = lambda m: sum(b[i] if m >> i & 1 else c[i] for i in range(n)) + sum(w for i, j, w in edges if (m >> i & 1) != (m >> j & 1))
        best = min(map(cost, range(1 << n)))
        found = sum(1 << i for i, x in enumerate(html_text.min_cut(c, b, edges)) if x)
        assert cost(found) == best
        assert found.bit_count() == max(m.bit_count() for m in range(1 << n) if cost(m) == best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header><p>Site name and slogan.</p></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First  paragraph<br>goes on.<!-- no --><p>Second &lt;one&gt; with <b>bold</b> and <a href="x">link</a>.
<form><p>Subscribe</p><input></form><aside>Read this too.</aside><section class="comments"><p>A reader says that this is long.</p></section>
<p>Last.</p></article><div id="sidebar"><p>More of the same.</p></div><footer>&copy; all</footer></body></html>"""


def test_page(spark):
    expected = "Title & more\n\nFirst paragraph goes on.\n\nSecond <one> with bold and link.\n\nLast."
    assert html_text.main_text(PAGE, html_text.PRIOR) == expected
    rows = [(1, "u", PAGE, "clash"), (2, None, None, ""), (3, "u", "", ""), (4, "u", "<<<a '\"<p", ""), (1, "u", PAGE, "clash"), (5, "u", "<script>x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_texts(pages).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 1} == {expected}
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3, 5))
    assert html_text.main_texts(pages.where("false")).collect() == []


def test_page_without_semantic_tags():
    prose = "This is a long sentence of an article, with many words in it. And another one follows here, as they do."
    page = "<div>" + "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(8)) + "</div><div>" + f"<p>{prose}</p>" * 4 + "<p>Short.</p>" + f"<p>{prose}</p></div>"
    assert html_text.main_text(page, html_text.PRIOR) == "\n\n".join([prose] * 4 + ["Short.", prose])


def test_deep_and_broken_pages():
    assert len(html_text.blocks("<div><p>a" * 5_000)) == 5_000
    assert html_text.blocks("</div></p>x</article>")[0].text == "x"
    assert html_text.blocks(html.escape("<p>") + "&nbsp;&#65;")[0].text == "<p> A"


# ---- rollups ----


def test_rollup(spark, tmp_path):
    kind = "seq int, op string, doc_id long, source string, lang string, version string, tokens long"
    rnd = random.Random(7)
    store, held = token_rollup.Rollup(spark, str(tmp_path / "r")), {}
    assert store.totals().collect() == []
    for batch in range(4):
        changes = []
        for seq in range(40):
            op = rnd.choice(["insert", "revise", "delete"])
            key, value = (rnd.randint(0, 25), rnd.choice(["v1", None])), (rnd.choice(["s", None]), "en", rnd.randint(0, 50))
            changes.append((seq, op, key[0], value[0], value[1], key[1], value[2]))
            held.pop(key, None)
            if op != "delete":
                held[key] = value
        rows = spark.createDataFrame(changes, kind)
        assert store.commit(f"b{batch}", rows) and not store.commit(f"b{batch}", rows)
        assert not store.commit(f"b{batch}", rows.withColumn("tokens", F.lit(9).cast("long")))
        docs, tokens = Counter(), Counter()
        for (_, version), (source, lang, n) in held.items():
            docs[source, lang, version] += 1
            tokens[source, lang, version] += n
        got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
        assert got == {k: (docs[k], tokens[k]) for k in docs}
    assert store.commit("empty", spark.createDataFrame([], kind)) and len(store.batches()) == 5


def test_broken_batch_is_not_counted(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(0, "insert", 1, "s", "en", "v", 5)], "seq int, op string, doc_id long, source string, lang string, version string, tokens long")
    store.commit("a", rows)
    (tmp_path / "r/totals/batch=a/_SUCCESS").unlink()
    assert store.totals().collect() == [] and store.commit("a", rows)
    assert [(r["docs"], r["tokens"]) for r in store.totals().collect()] == [(1, 5)]


def test_rows_that_repeat_a_document_are_read_once(spark, monkeypatch):
    """A document that comes 300 times, and null ids of one text, beside a variant: each kind of fragment is gathered once."""
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(2000))
    variant = base[:900] + "XYZ" + base[900:]
    texts = [(1, base)] * 300 + [(None, base)] * 50 + [(2, variant), (3, "other " * 80)]
    gathered = []

    def counted(texts, kinds, doc, own=suffix_dedup._with_text):
        found = own(texts, kinds, doc)
        gathered.append((kinds.count(), found.count()))
        return found

    monkeypatch.setattr(suffix_dedup, "_with_text", counted)
    got = {(r["doc_id"], r["n_bytes"]): bytes(r["kept"]).decode() for r in suffix_dedup.repeats(docs_of(spark, texts)).collect()}
    assert gathered and all(kinds == rows for kinds, rows in gathered) and any(kinds for kinds, _ in gathered)
    assert got[1, 2000] == got[None, 2000] == ""
    around = variant[900 - 199 : 903 + 199]  # windows of 200 bytes that hold the inserted ones
    assert got[2, 2003] == "XYZ" and "XYZ" in around
