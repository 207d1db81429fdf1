"""Quantile sketches by batch: merging, retries and the bound of their error."""

import random

from pyspark.sql import functions as F

from tallgrass.operators import metrics

RESULTS = "model string, task int, latency array<double>, input_tokens array<long>, output_tokens array<long>"


def test_step_values(spark):
    rows = [("m", 1, [0.5, 1.5], [10, 20], [3]), ("m", 2, [], None, None), ("n", 3, None, [7], [8])]
    got = sorted(tuple(r) for r in metrics.step_values(spark.createDataFrame(rows, RESULTS)).collect())
    assert got == [("m", 1, 0, 0.5, 10, 3), ("m", 1, 1, 1.5, 20, None), ("n", 3, 0, None, 7, 8)]


def test_merged_batches_stay_within_the_bound(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(m, rnd.randrange(2), rnd.lognormvariate(0, 1) if rnd.random() < 0.99 else None) for m in "ab" for _ in range(6000)]
    path = str(tmp_path / "sketches")
    for n in range(4):
        part = spark.createDataFrame(rows[n::4], "model string, step int, latency double")
        metrics.write_sketches(part, ["model", "step"], "latency", path, str(n))
    metrics.write_sketches(part, ["model", "step"], "latency", path, "3")  # sent again
    found = metrics.quantiles(metrics.merged_sketches(spark.read.parquet(path), ["model", "step"]), [0.05, 0.5, 0.95]).collect()
    assert len(found) == 4
    for r in found:
        own = sorted(x for m, s, x in rows if (m, s) == (r["model"], r["step"]) and x is not None)
        assert (r["n"], r["least"], r["most"]) == (len(own), own[0], own[-1]) and abs(r["mean"] - sum(own) / len(own)) < 1e-9
        for q in r["quantiles"]:
            assert abs(sum(x <= q["value"] for x in own) / len(own) - q["at"]) < 0.03


def test_few_values_are_exact_and_none_give_no_row(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None)], "model string, latency double")
    found = metrics.quantiles(metrics.quantile_sketches(rows, ["model"], "latency"), [0.5]).collect()
    assert [(r["model"], r["n"], r["quantiles"][0]["value"]) for r in found] == [("a", 3, 2.0)]
    assert metrics.merged_sketches(metrics.quantile_sketches(rows.where(F.lit(False)), ["model"], "latency"), ["model"]).count() == 0
