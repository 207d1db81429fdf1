"""Readers, sinks, commands and the request stream on small files."""

import json

from pyspark.sql import functions as F

from tallgrass.operators.retrieval import Models
from tallgrass.plans import commands
from tallgrass.sources import readers, sinks
from tallgrass.streaming import requests


def tool(name, description="does things", properties=None, **more):
    properties = {"p": {"type": "float", "description": "a p"}} if properties is None else properties
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": ["p"]}}} | more


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_catalog(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", [tool("a"), tool("b")], "", tool("c"), tool("a", "other"), {"type": "function", "function": {}})
    rows = readers.load_json_or_jsonl(spark, path).orderBy("ord").collect()
    assert [json.loads(r["json"])["function"].get("name") for r in rows] == ["a", "b", "c", "a", None]
    first = {r["name"]: r["description"] for r in readers.load_catalog(spark, path).collect()}
    assert first == {"a": "does things", "b": "does things", "c": "does things"}
    last = {r["name"]: (r["description"], r["ord"]) for r in readers.load_catalog(spark, path, "last").collect()}
    assert last["a"] == ("other", 0)
    one = write(tmp_path / "c.json", json.dumps([[tool("a"), tool("b")]], indent=1))
    assert readers.load_json_or_jsonl(spark, one).count() == 2
    bad = write(tmp_path / "bad.jsonl", tool("a"), "{nope", [tool("b")])
    fixed = readers.load_fixed_catalog(spark, bad).collect()
    assert sorted(r["name"] for r in fixed) == ["a", "b"] and all('"number"' in r["json"] for r in fixed)


def test_other_readers(spark, tmp_path):
    edges = write(tmp_path / "e.csv", "tool_name,tool_type,neighbor_name,neighbor_type,similarity,rank", "a,original,b,synthetic,0.8,1", "a,original,c,synthetic,0.6,2")
    assert readers.load_edges(spark, edges, least=0.75).count() == 1
    cache = write(tmp_path / "s.json", {"tools": [tool("a")], "count": 1})
    assert readers.load_schema_cache(spark, cache).count() == 1
    assert readers.load_schema_cache(spark, write(tmp_path / "t.json", "broken")).count() == 0
    vectors = readers.load_embedding_cache(spark, write(tmp_path / "v.json", {"a: x": [1.0, 2.0]})).collect()
    assert [(r["text"], r["v"]) for r in vectors] == [("a: x", [1.0, 2.0])]
    (tmp_path / "result" / "m1").mkdir(parents=True)
    write(tmp_path / "result" / "m1" / "b_result.jsonl", {"id": "x_2"}, {"id": "x_10"})
    got = readers.load_results(spark, str(tmp_path / "result"), "b", ["m1"])
    assert {r["model"] for r in got.collect()} == {"m1"}
    rows = readers.load_records(spark, str(tmp_path / "result" / "m1" / "b_result.jsonl"), by_id=True).collect()
    assert [r["id"] for r in rows] == ["x_2", "x_10"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    out = str(tmp_path / "u")
    sinks.write_upserted(spark, rows, out, "id")
    sinks.write_upserted(spark, spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string"), out, "id")
    assert sorted((r["id"], r["x"]) for r in spark.read.json(out).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert not sinks.write_csv(rows.where("id > 9"), str(tmp_path / "n"), skip_empty=True)
    assert sinks.write_csv(rows, str(tmp_path / "y"))
    assert json.loads(sinks.report(spark, n=3, s="x").first()["json"]) == {"n": 3, "s": "x"}
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    sinks.write_jsonl(rows, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def _catalogs(spark, tmp_path):
    words = ["weather forecast rain", "weather forecast wind", "music player songs", "music player radio", "flight booking ticket", "hotel booking room"]
    original = readers.load_catalog(spark, write(tmp_path / "o.jsonl", *[tool(f"o{i}", w) for i, w in enumerate(words)]))
    made = [tool(f"s{i}", w, _source_tool=f"o{(i + 1) % 6}") for i, w in enumerate(words)] + [tool("o1", "clash", _source_tool="o2")]
    return original, readers.load_catalog(spark, write(tmp_path / "s.jsonl", *made))


def test_commands(spark, tmp_path):
    original, synthetic = _catalogs(spark, tmp_path)
    tasks = spark.createDataFrame([("o0", 1, "will it rain"), ("o0", 0, "any wind"), ("o2", 0, "play it")], "name string, ord int, text string")
    embed = commands.tfidf_embedder(100, 8)
    got = commands.analyze(original, tasks, embed, k=2, clusters=2)
    assert got["neighbors"].count() == 12
    stats = {r["tool_name"]: (r["task_count"], r["example_tasks"]) for r in got["task_stats"].collect()}
    assert stats["o0"] == (2, "any wind | will it rain") and stats["o5"] == (0, "")
    assert got["clusters"].count() == 6 and got["summary"].first()["tools"] == 6
    gold = commands.rebuild(original, synthetic, embed, k=3)
    report = gold["report"].first()
    assert report["original_after"] == 6 and report["synthetic_after"] == 7 and 6 <= report["gold"] <= 12
    rules = gold["rules"].first()
    assert rules["kept"] + rules["rule1"] + rules["rule2"] + rules["rule3"] == rules["synthetic"] == gold["synthetic"].count() == 7
    assert rules["rule1"] == 1 and rules["gold"] == report["gold"] and gold["original"].count() == 6
    quality = commands.quality(original, synthetic, embed, k=3)
    assert quality["report"].first()["edges"] == 39
    groups = commands.regroup(original, 4).orderBy("chunk").collect()
    assert [len(r["items"]) for r in groups] == [4, 2]
    made = commands.expand(original, got["neighbors"].withColumn("raw", F.col("similarity")), tasks, threshold=0.99, least=2)
    assert made.where("name LIKE '%_variant_%'").count() == made.count() > 0
    assert commands.prepare_schemas(original)["errors"].count() == 0


def test_reply_lines(spark):
    reply = "```json\n# made\n" + json.dumps(tool("a")) + "\nnope\n{}\n```"
    assert len(spark.createDataFrame([(reply,)], "r string").select(commands.parsed_lines(F.col("r"))).first()[0]) == 1


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.json", {"request": "r1", "messages": [{"role": "user", "content": "hi"}]}, {"request": "r2", "mode": "odd", "messages": []})
    tools = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "ord long, name string, v array<double>")
    stream = spark.readStream.schema(requests.REQUEST).json(str(tmp_path / "in"))
    requests.serve(stream, tools, Models(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["request"], r["name"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("r1", "a", None), ("r1", "b", None), ("r2", None, "unknown mode")}
