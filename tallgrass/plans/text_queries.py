"""Queries of text analytics and evaluation metrics over the driver's tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as text_functions
from tallgrass.functions.text import GENERIC, STOPWORDS
from tallgrass.operators import metrics, terms
from tallgrass.operators.relational import settled
from tallgrass.operators.vectors import nearest

#: A sketch's ranks may be off by so much of the rows.
NEAR = 0.03

_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = f"""
WITH words AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
toks AS (SELECT id, term FROM words WHERE regexp_full_match(term, '[a-z0-9][a-z0-9_]*') AND length(term) > 2
         AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_WORDS})),
vocab AS (SELECT term, count(*) AS n FROM toks GROUP BY 1 ORDER BY n DESC, term LIMIT 5000),
tf AS (SELECT id, term, count(*) AS n FROM toks WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS raw FROM tf JOIN df USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)
"""


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def vocab(spark, d):
    return terms.vocabulary(_docs(spark, d))


def tfidf(spark, d):
    return terms.tfidf(_docs(spark, d)).select("id", "term", F.round("weight", 6).alias("weight"))


def tfidf_topwords(spark, d):
    return terms.top_words(terms.tfidf(_docs(spark, d)))


def tfidf_neighbors(spark, d):
    """Neighbours of each hundredth document."""
    docs = _docs(spark, d)
    found = terms.text_similarity(docs, docs.where("id % 100 = 0"))
    return found.withColumn("rank", F.col("rank").cast("long"))


def svd_neighbors(spark, d):
    """Neighbours of each hundredth document after projection on the strongest singular directions."""
    v = settled(terms.project_texts(_docs(spark, d)))
    return nearest(v.where("id % 100 = 0"), v, 5, same=True).select("query", "item", "similarity", "rank")


def cluster_labels(spark, d):
    """The sources as clusters, labelled by their terms."""
    docs = _docs(spark, d)
    rows = docs.select(F.col("source").alias("cluster"), F.explode(text_functions.tokens(F.col("text"))).alias("term"))
    return terms.labels(rows.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n")))


def cluster_overview(spark, d):
    docs = _docs(spark, d)
    members = docs.select(F.col("source").alias("cluster"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name"), F.col("lang").alias("description"))
    return terms.overview(members)


def task_stats(spark, d):
    """Customers as tools, their orders as tasks."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    tools = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("name"))
    tasks = orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"))
    return terms.task_stats(tools, tasks)


def _tasks(spark, d):
    """Events as evaluated tasks: a user's events in order of time are a dialogue."""
    events = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("dialogue"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("correct"),
        ((F.col("event_type") != "error") & (F.col("value") < 20)).alias("is_optimal"),
        F.when(F.col("event_id") % 3 == 0, "Coreferential Reference").when(F.col("event_id") % 3 == 1, "Partial Information").otherwise("Long-Range Dependency").alias("subtype"),
        (F.col("event_id") % 4).alias("done"),
        F.lit(4).alias("expected"),
    )


KINDS = ["click", "error", "purchase", "signup", "view"]


def acc_total(spark, d):
    return metrics.totals(_tasks(spark, d))


def acc_type_rollup(spark, d):
    return metrics.by_kind(_tasks(spark, d), "Active", F.col("kind").isin("click", "purchase", "signup"), [*KINDS, "Active", "Absent"])


def acc_layer(spark, d):
    return metrics.by_layer(_tasks(spark, d))


def acc_turn_subtype(spark, d):
    return metrics.by_turn(_tasks(spark, d))


def optimal_rate(spark, d):
    return metrics.optimal(_tasks(spark, d), ["click", "purchase"])


def progress_rate(spark, d):
    return metrics.progress(_tasks(spark, d), ["purchase", "view"])


def tool_text(spark, d):
    """Parts rendered as tools."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    parameter = lambda name, kind, text, options: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), text.alias("description"), options.alias("options")
    )
    none = F.array().cast("array<string>")
    parameters = F.array(
        parameter("size", "integer", F.col("p_size").cast("string"), none),
        parameter("brand", "string", F.col("p_brand"), F.array("p_brand", F.lit("other"))),
    )
    text = text_functions.tool_text(F.col("p_name"), F.col("p_type"), parameters, F.array(F.lit("size")))
    return parts.select("p_partkey", text.alias("text"))


def search_filter(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    hit = text_functions.matches_search(F.col("p_name"), F.col("p_type"), "RED")
    return parts.where(hit).select("p_partkey", "p_name", "p_type")


def latency_sketches(spark, d):
    """Quantile sketches of the events' values by type and step, made in five batches and merged; whether ranks are near.

    A quantile's true rank is the share of values up to it.
    """
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("model"), (F.col("event_id") % 4).alias("step"), (F.col("event_id") % 5).alias("batch"), "value")
    parts = metrics.quantile_sketches(events, ["model", "step", "batch"], "value")
    found = settled(metrics.quantiles(metrics.merged_sketches(parts, ["model", "step"]), [0.1, 0.5, 0.9, 0.99]))
    points = found.select("model", "step", "n", F.inline("quantiles"))
    key = ["model", "step"]
    met = events.withColumnRenamed("value", "x").join(points, key).groupBy(*key, "at")
    share = lambda c: F.count_if(c) / F.first("n")
    ranks = met.agg(share(F.col("x") <= F.col("value")).alias("upto"), share(F.col("x") < F.col("value")).alias("below"))
    near = ranks.groupBy(*key).agg(F.bool_and((F.col("upto") >= F.col("at") - NEAR) & (F.col("below") <= F.col("at") + NEAR)).alias("near"))
    rounded = lambda c: F.round(c, 4).alias(c)
    return found.join(near, key).select(*key, "n", rounded("total"), "least", "most", rounded("mean"), "near")


QUERIES = {
    f.__name__: f
    for f in (
        vocab, tfidf, tfidf_topwords, tfidf_neighbors, svd_neighbors, cluster_labels, cluster_overview, task_stats, acc_total,
        acc_type_rollup, acc_layer, acc_turn_subtype, optimal_rate, progress_rate, tool_text, search_filter, latency_sketches,
    )
}

_TASKS = """
WITH t AS (SELECT user_id AS dialogue, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS kind,
  event_type <> 'error' AS correct, event_type <> 'error' AND value < 20 AS is_optimal,
  CASE event_id % 3 WHEN 0 THEN 'Coreferential Reference' WHEN 1 THEN 'Partial Information' ELSE 'Long-Range Dependency' END AS subtype,
  event_id % 4 AS done FROM events)
"""


def _rates(rows: str, keys: str | None = None) -> str:
    counted = f", r AS ({rows}), c AS (SELECT key, CAST(sum(p) AS BIGINT) AS correct, CAST(sum(w) AS BIGINT) AS total FROM r GROUP BY 1)"
    if keys is None:
        return _TASKS + counted + " SELECT key, correct, total, coalesce(round(correct / nullif(total, 0), 6), 0.0) AS ratio FROM c"
    return (
        _TASKS
        + counted
        + f""", k AS (SELECT unnest({keys}) AS key)
SELECT k.key, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, coalesce(round(correct / nullif(total, 0), 6), 0.0) AS ratio
FROM k LEFT JOIN c USING (key)"""
    )


SQL = {
    "latency_sketches": """SELECT event_type AS model, event_id % 4 AS step, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most,
round(avg(value), 4) AS mean, true AS near FROM events GROUP BY 1, 2""",
    "vocab": _TERMS + "SELECT term, n FROM vocab",
    "tfidf": _TERMS + "SELECT id, term, round(weight, 6) AS weight FROM weights",
    "tfidf_topwords": _TERMS + "SELECT term, round(sum(weight), 6) AS total FROM weights GROUP BY 1 ORDER BY total DESC, term LIMIT 20",
    "tfidf_neighbors": _TERMS
    + """, x AS (SELECT q.id AS query, w.id AS item, round(sum(q.weight * w.weight), 6) AS similarity
FROM weights q JOIN weights w USING (term) WHERE q.id % 100 = 0 AND q.id <> w.id GROUP BY 1, 2)
SELECT query, item, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM x QUALIFY rank <= 5""",
    "cluster_labels": _TERMS.split("vocab AS")[0].rstrip().rstrip(",").replace("doc_id AS id,", "source AS id,")
    + f""", c AS (SELECT id AS cluster, term, count(*) AS n FROM toks GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS r FROM c QUALIFY r <= 15),
g AS (SELECT cluster, list(term ORDER BY r) AS every, list(term ORDER BY r) FILTER (term NOT IN ({", ".join(f"'{w}'" for w in GENERIC)})) AS telling FROM r GROUP BY 1)
SELECT cluster, array_to_string(list_slice(CASE WHEN len(telling) > 0 THEN telling ELSE every END, 1, 5), ', ') AS label FROM g""",
    "cluster_overview": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT source AS cluster, count(*) AS size, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY r) FILTER (r <= 6) AS names,
string_agg(lang, ' | ' ORDER BY r) FILTER (r <= 6) AS descriptions FROM r GROUP BY 1""",
    "task_stats": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT c_custkey AS name, count(o_orderkey) AS task_count, coalesce(string_agg(o_orderpriority, ' | ' ORDER BY r) FILTER (r <= 3), '') AS examples
FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1""",
    "acc_total": _TASKS
    + """, s AS (SELECT bool_and(correct) AS ok FROM t GROUP BY dialogue),
c AS (SELECT 'task' AS key, count(*) FILTER (correct) AS correct, count(*) AS total FROM t UNION ALL SELECT 'session', count(*) FILTER (ok), count(*) FROM s)
SELECT key, correct, total, round(correct / total, 6) AS ratio FROM c""",
    "acc_type_rollup": _rates(
        """SELECT kind AS key, CAST(correct AS INT) AS p, 1 AS w FROM t UNION ALL
SELECT 'Active', CAST(correct AS INT), 1 FROM t WHERE kind IN ('click', 'purchase', 'signup')""",
        "['click', 'error', 'purchase', 'signup', 'view', 'Active', 'Absent']",
    ),
    "acc_layer": _rates("SELECT CAST(pos AS VARCHAR) AS key, CAST(correct AS INT) AS p, 1 AS w FROM t WHERE pos < 4", "['0', '1', '2', '3']"),
    "acc_turn_subtype": _rates(
        """SELECT CASE WHEN pos = 0 THEN 'First Turn' ELSE subtype END AS key, CAST(correct AS INT) AS p, 1 AS w FROM t UNION ALL
SELECT 'Subsequent Turn', CAST(correct AS INT), 1 FROM t WHERE pos > 0"""
    ),
    "optimal_rate": _rates(
        """SELECT unnest([kind, 'Total']) AS key, CAST(is_optimal AS INT) AS p, 1 AS w FROM t WHERE kind IN ('click', 'purchase')""",
        "['click', 'purchase', 'Total']",
    ),
    "progress_rate": _rates(
        "SELECT unnest([kind, 'Total']) AS key, done AS p, 4 AS w FROM t WHERE kind IN ('purchase', 'view')", "['purchase', 'view', 'Total']"
    ),
    "tool_text": """SELECT p_partkey, 'Tool: ' || p_name || chr(10) || 'Description: ' || p_type || chr(10) || 'Parameters:' || chr(10)
|| '- brand (string): ' || p_brand || ' Options=[''' || p_brand || ''', ''other''].' || chr(10) || '- size (integer): ' || p_size || chr(10)
|| 'Required: size' AS text FROM part""",
    "search_filter": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')",
}
