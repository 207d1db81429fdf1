"""Queries of the subpackage that SQL can express, and the columns that their contracts name."""

import os

import duckdb
import pytest

from tallgrass.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_html_text": ["page_id", "url", "text", "n_chars"],
}


def test_all_operators_have_a_query_that_the_driver_sees():
    import __spark_entry__

    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, name):
    """One row for each row of the table, with the columns of the contract."""
    df = queries.queries()[name](spark, SF)
    table = "pages" if COLUMNS[name][0] == "page_id" else "documents"
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    key = COLUMNS[name][0]
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in df.select(key).collect()) == ids


def test_shards_have_gapless_slots_and_near_equal_bytes(spark):
    rows = queries.op5_sharding(spark, SF).collect()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert 0 <= shard < 40 and slots == list(range(len(slots)))
