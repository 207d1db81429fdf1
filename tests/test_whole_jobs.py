"""Queries against plain Python over whole tables: no row is left out by its id."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallgrass.operators import terms

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_plan_rules_checks_every_line_item(spark):
    expected = Counter()
    for r in rows_of(spark, "lineitem"):
        known = {"A": {"quantity", "tax"}, "N": {"quantity"}}.get(r["l_returnflag"])
        given = {"quantity": r["l_quantity"] if r["l_quantity"] > 25 else ""} | ({"tax": r["l_tax"]} if r["l_linenumber"] % 2 == 0 else {})
        errors = ["simulation"] * (r["l_linestatus"] == "O")
        errors += ["unknown tool"] if known is None else ["unknown argument"] * bool(set(given) - known) + ["empty required"] * (given["quantity"] == "")
        expected["; ".join(sorted(errors))] += 1
    got = {r["errors"]: r["n"] for r in entry.queries()["plan_rules"](spark, SF).collect()}
    assert got == expected


def test_svd_neighbors_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(terms, "PRODUCT_WEIGHTS", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    weights = terms.tfidf(docs, 5_000).collect()
    ids, names = sorted({r["id"] for r in weights}), sorted({r["term"] for r in weights})
    row, column = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(names)}
    matrix = np.zeros((len(ids), len(names)))
    for r in weights:
        matrix[row[r["id"]], column[r["term"]]] = r["weight"]
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    v = u[:, :128] * s[:128]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cosines = v @ v.T
    np.fill_diagonal(cosines, -2)
    got = entry.queries()["svd_neighbors"](spark, SF).collect()
    queries = [i for i in ids if i % 100 == 0]
    assert len(names) > 500 and len(got) == 5 * len(queries)
    for q in queries:
        own = sorted((r["rank"], r["similarity"], r["item"]) for r in got if r["query"] == q)
        assert np.allclose([x for _, x, _ in own], np.sort(cosines[row[q]])[::-1][:5], atol=1e-5)
        assert np.allclose([cosines[row[q], row[item]] for *_, item in own], [x for _, x, _ in own], atol=1e-5)


def test_retrieval_searches_every_vector(spark, tmp_path):
    rnd = np.random.RandomState(5)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(450)]
    for i in (100, 300):  # hundredth vectors near the query 0
        rows[i] = (i, [x + 0.01 * i / 100 for x in rows[0][1]])
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = str(tmp_path)
    ids = np.array([i for i, _ in rows])
    v = np.array([e for _, e in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cosines = v @ v.T
    np.fill_diagonal(cosines, -2)
    near = {int(q): [int(ids[k]) for k in np.lexsort((ids, -own))[:10]] for q, own in zip(ids, cosines) if q % 100 == 0}
    got = {(r["query"], r["rank"]): r["item"] for r in entry.queries()["retrieve_topk"](spark, d).collect()}
    assert got == {(q, k + 1): item for q, items in near.items() for k, item in enumerate(items[:5])}
    assert near[0][:2] == [100, 300]
    places = {0: [3, 1, 0], 100: [9, 8, 7, 6, 5], 200: [0, 1, 2, 3, 4], 300: [], 400: [2]}
    got = {(r["request"], r["rank"]): r["name"] for r in entry.queries()["rerank_sanitize"](spark, d).collect()}
    assert got == {(q, k + 1): items[at] for q, items in near.items() for k, at in enumerate(places[q % 500])}


def test_upsert_keeps_orders_that_have_the_number_of_an_added_one(spark, tmp_path):
    rows = [(7, "O", 1.0), (14, "F", 2.0), (8, "P", 3.0), (1_000_007, "O", 4.0), (1_000_014, "F", 5.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = sorted(tuple(r) for r in entry.queries()["upsert_latest"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["upsert_latest"]).fetchall()) and len(got) == 7


def test_neighbours_over_terms_by_blocks(spark, monkeypatch):
    """Small blocks and parts give the brute-force neighbours; equal ones come by id, and what shares no term is none."""
    monkeypatch.setattr(terms, "DOCUMENTS", 7)
    monkeypatch.setattr(terms, "QUERIES", 3)
    monkeypatch.setattr(terms, "QUERY_BYTES", 200)
    rnd = np.random.RandomState(8)
    m = rnd.rand(60, 12) * (rnd.rand(60, 12) < 0.3)
    m[[20, 31, 44]] = m[20]
    m[50], m[:50, 11], m[51:, 11] = 0, 0, 0
    m[50, 11] = 1
    weights = spark.createDataFrame([(int(i), f"t{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))], "id long, term string, weight double")
    queries = spark.range(0, 60, 5).toDF("id")
    got: dict = {}
    for r in terms.term_similarity(weights, queries, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["item"], r["similarity"]))
    raw = np.round(m @ m.T, 6)
    want = {q: [(i, raw[q, i]) for i in sorted(range(60), key=lambda i: (-raw[q, i], i)) if i != q and raw[q, i] > 0][:5] for q in range(0, 60, 5)}
    assert {q: [(i, x) for _, i, x in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v} and 50 not in got
