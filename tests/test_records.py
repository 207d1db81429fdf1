"""Records as JSON, what tools take, and the sinks of documents, backups and transcripts."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import curation, dialogue, records, retrieval, vectors
from tallgrass.sources import readers, sinks

RECORDS = [
    (1, '{"english_tools": [{"function": {"name": "a"}}, "b", {"name": "c"}, 3, "b"], "tools": ["z"], "english_tasks": [" x ", {"input": " y "}, {"q": 1}, 5, ""], "tasks": ["t"]}'),
    (2, '{"english_tools": [], "tools": ["a"], "english_tasks": [], "tasks": ["fall"]}'),
    (3, "bad"),
    (4, None),
]


@pytest.mark.parametrize(
    "by, strip, want",
    [
        ("truthy", True, {"a": ["x", "y", '{"q":1}', "5", "fall"], "b": ["x", "y", '{"q":1}', "5"] * 2}),
        ("present", False, {"a": [" x ", " y ", '{"q":1}', "5", ""], "b": [" x ", " y ", '{"q":1}', "5", ""] * 2}),
    ],
)
def test_catalog_tasks(spark, by, strip, want):
    rows = spark.createDataFrame(RECORDS, "id int, json string")
    catalog = spark.createDataFrame([("a",), ("b",), ("z",), ("a",), (None,)], "name string")
    got: dict = {}
    for r in records.catalog_tasks(rows, catalog, by, strip).orderBy("ord").collect():
        got.setdefault(r["name"], []).append(r["text"])
    assert got == want
    assert records.catalog_tasks(rows.where("id > 9"), catalog).count() == 0


def test_what_tools_take(spark):
    tools = [("f", '{"function": {"parameters": {"properties": {"b": {}, "a": {}}, "required": ["a"]}}}'), ("g", "{}"), ("h", "no json"), ("i", None)]
    info = records.tool_info(spark.createDataFrame(tools, "name string, json string"))
    assert [tuple(r) for r in info.orderBy("name").collect()] == [("f", ["b", "a"], ["a"], ["b"]), *((n, [], [], []) for n in "ghi")]
    assert records.told_info(info).orderBy("name").first()["told"] == "Tool f needs [a] and may be given [b]."


def test_forms_of_definitions(spark):
    row = spark.range(1)
    schema = row.select(records.input_schema(F.lit('{"name": "f", "parameters": {"x": {"type":"float"}}}'))).first()[0]
    assert json.loads(schema) == {"name": "f", "inputSchema": {"x": {"type": "number"}}}
    reply = '# hi\n```json\n{"function": {"name": "f"}, "reason": "r"}\n{"type":"x","function":{"name":"g"}}\n{"function":{}}\nnope\n\n```'
    made = row.select(records.generated_tools(F.lit(reply))).first()[0]
    assert [json.loads(x) for x in made] == [{"function": {"name": "f"}, "type": "function"}, {"function": {"name": "g"}, "type": "x"}]


# ---- sinks ----


def lines(spark, path):
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def test_backup(spark, tmp_path):
    path = str(tmp_path / "gold")
    assert not sinks.write_with_backup(spark.range(3), path)
    assert sinks.write_with_backup(spark.read.parquet(path).where("id > 0"), path)
    assert sinks.write_with_backup(spark.read.parquet(path).where("id > 1"), path)
    assert [spark.read.parquet(p).count() for p in (path, f"{path}.backup")] == [1, 2]


def test_versions_are_not_overwritten(spark, tmp_path):
    out = sinks.write_versioned(spark.range(2), str(tmp_path), "1")
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_versioned(spark.range(2), str(tmp_path), "1")


def test_stringified(spark, tmp_path):
    kind = "a int, b struct<d:date,e:array<decimal(5,2)>>, c map<int,binary>, t timestamp"
    rows = [(1, (datetime.date(2024, 1, 2), [decimal.Decimal("1.50")]), {7: b"x"}, None), (2, None, None, datetime.datetime(2024, 1, 2, 3))]
    sinks.write_jsonl(sinks.stringified(spark.createDataFrame(rows, kind)), str(tmp_path / "out"))
    got = sorted(lines(spark, str(tmp_path / "out")), key=lambda r: r["a"])
    assert got == [
        {"a": 1, "b": {"d": "2024-01-02", "e": ["1.50"]}, "c": {"7": "x"}, "t": None},
        {"a": 2, "b": None, "c": None, "t": "2024-01-02 03:00:00"},
    ]


def test_batches_go_on_from_an_offset(spark, tmp_path):
    tools = spark.createDataFrame([('{"n": 1}',)], "json string")
    told = lambda n: spark.createDataFrame([(n, "src")], "n int, source string")
    path = str(tmp_path / "made")
    assert sinks.write_batch(tools, told(1), path).count() == 1
    assert sorted(r["n"] for r in sinks.write_batch(tools, told(2), path, offset=1).collect()) == [1, 2]
    assert len(lines(spark, f"{path}/tools")) == 2
    assert sinks.write_batch(tools, told(3), path).count() == 1


@pytest.mark.parametrize("n", [0, 1, 50])
def test_document(spark, tmp_path, n):
    tools = spark.range(n).select((-F.col("id")).alias("ord"), F.concat(F.lit('{"name": "t'), "id", F.lit('"}')).alias("json")).repartition(3)
    path = tmp_path / "cache"
    assert sinks.write_document(tools, str(path), source="x", version="1.0") == n
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert json.loads(text) == {"tools": [{"name": f"t{i}"} for i in reversed(range(n))], "count": n, "metadata": {"source": "x", "version": "1.0"}}


def test_transcripts(spark, tmp_path):
    kind = "id int, messages array<string>, cleaned array<string>, calls array<struct<agent:string,prompt:string>>"
    rows = [(1, ["a", "b"], ["a"], [("user", "p"), None]), (2, None, None, [("x", "y")]), (3, ["c"], ["c"], None)]
    sinks.write_transcripts(spark.createDataFrame(rows, kind), str(tmp_path))
    got = {name: sorted(lines(spark, f"{tmp_path}/{name}"), key=str) for name in ("origin", "train", "fetch_data")}
    assert got["origin"] == [{"id": 1, "messages": ["a", "b"]}, {"id": 3, "messages": ["c"]}]
    assert got["train"] == [{"id": 1, "messages": ["a"]}, {"id": 3, "messages": ["c"]}]
    assert got["fetch_data"] == [{"id": 1, "agent": "user", "prompt": "p"}]


# ---- small columns ----


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], 0.70711), ([1.0, 2.0, 9.0], [1.0, 2.0], 0.24112), ([0.0], [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert [round(r[0], 5) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [w for *_, w in rows]


def test_parent_and_control_tools(spark):
    df = spark.createDataFrame([("s", None, "p"), (None, "c", "p"), (None, None, None)], "_source_tool string, created_from string, parent string")
    assert [r[0] for r in df.select(curation.parent_of(df)).collect()] == ["s", "c", None]
    assert [r[0] for r in df.select(curation.parent_of(df, strict=True)).collect()] == ["p", "c", None]
    tools = spark.createDataFrame([([("f",), (dialogue.ASK,), (dialogue.ANSWER,)],)], "tools array<struct<name:string>>")
    assert tools.select(dialogue.without_control_tools(F.col("tools"))["name"]).first()[0] == ["f"]


def test_vectors_from_a_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    cache = spark.createDataFrame([("a", [1.0, 2.0])], "text string, v array<double>")
    found = {r["id"]: r["v"] for r in retrieval.with_vectors(rows, "text", cache, 2).collect()}
    assert found[1] == [1.0, 2.0] and found[2] == [0.0, 0.0]


def test_follow_ups_are_drawn_alike_on_every_run(spark):
    rows = spark.range(4400).select(dialogue.follow_up("id").alias("f")).select("f.*")
    seen: dict = {}
    for r in rows.collect():
        seen[r["style"], r["variant"]] = seen.get((r["style"], r["variant"]), 0) + 1
    assert set(seen) == {(s, n) for s, count in dialogue.FOLLOW_UPS.items() for n in range(count)} and 120 < min(seen.values()) <= max(seen.values()) < 290
    assert {tuple(r) for r in rows.limit(9).collect()} <= set(seen)


def test_first_existing_path(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert readers.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path)]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "a")])
