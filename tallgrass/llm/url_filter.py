"""Operator 3: URL filters with link-graph propagation, in DataFrame functions only.

A rule names a host, with all its subdomains, and the start of a path.  The longest rule
that fits a url gives its verdict.  Other urls get the verdict of their host, which comes
from two propagations over the edges between hosts:

* trust: personalised PageRank from the hosts whose pages are allowed by rules;
* distrust: the same over the reversed edges from the hosts whose pages are blocked.

A host's seed is the share of its pages under such rules.  Scores are
(1 - damping) * seed + damping * (sum over in-edges of score * weight / out-weight), so a
fully blocked host without links has a distrust of 1 - damping.  A host is blocked where its
distrust is at least half of that and exceeds its trust.  With the default damping of 0.85
a host is thus never blocked for links alone while it is as much trusted.

Cases: null urls, and urls without "://", have an empty host and path; they fit no rule and
are allowed (verdicts of the empty host are never propagated); null or empty html has no
links; links without a host, or to the own host, are no edges; a very long url or html is
read whole; repeated rows each get their verdict and count in weights; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

Rule = tuple[str, str, str]  # verdict, host, start of the path

DAMPING = 0.85
TOLERANCE = 1e-6
#: More rounds than the tolerance takes; with none left there is an error, not a score.
ROUNDS = 1_000
#: Links with a host of their own: an optional scheme, two slashes, and the host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, or null.  The rules are literals of the plan."""
    fits = [
        F.when(
            ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path),
            F.struct(
                F.lit(len(rule_host + rule_path)).alias("size"),
                F.lit(rule_host + rule_path).alias("rule"),
                F.lit(verdict).alias("verdict"),
            ),
        )
        for verdict, rule_host, rule_path in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, weight: links between different hosts."""
    links = pages.select(
        host_of(F.col("url")).alias("source"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"),
    )
    target = F.translate("to", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        links.select("source", target.alias("target"))
        .where("source <> '' AND source <> target")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, score: personalised PageRank over edges (source, target, weight) from seeds (host, seed).

    It ends when no score moves by TOLERANCE; each round moves at most `damping` times as much
    in all as the one before, so that it ends.
    """
    outgoing = edges.groupBy("source").agg(F.sum("weight").alias("all"))
    shares = cut(edges.join(outgoing, "source").select("source", "target", (F.col("weight") / F.col("all")).alias("share")))
    own = seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"))
    scores = cut(own.where("score > 0"))
    if shares.isEmpty():
        return scores
    for _ in range(ROUNDS):
        sent = scores.join(shares, F.col("host") == F.col("source")).select(
            F.col("target").alias("host"), (damping * F.col("score") * F.col("share")).alias("score")
        )
        after = cut(own.where("score > 0").unionByName(sent).groupBy("host").agg(F.sum("score").alias("score")))
        moved = (
            after.join(scores.withColumnRenamed("score", "before"), "host", "left")
            .agg(F.max(F.abs(F.col("score") - F.coalesce("before", F.lit(0.0)))))
            .first()[0]
        )
        drop(scores)
        scores = after
        if (moved or 0.0) < TOLERANCE:
            return scores
    raise ArithmeticError(f"scores still move by {moved} after {ROUNDS} rounds")


def judge(pages: DataFrame, rules: Sequence[Rule], damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row for each row of `pages`."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = cut(
        rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    )
    edges = cut(host_edges(pages))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    trust = propagate(edges, hosts.select("host", F.col("allowed").alias("seed")), damping)
    distrust = propagate(back, hosts.select("host", F.col("blocked").alias("seed")), damping)
    scored = cut(
        hosts.select("host")
        .join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .fillna(0.0)
    )
    bad = (F.col("distrust") >= (1 - damping) / 2) & (F.col("distrust") > F.col("trust"))
    return rows.join(scored, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
