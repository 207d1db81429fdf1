"""Operator 10: token counts in delta-maintained rollups.

A change says that a document was inserted, deleted, or counted anew under a tokenizer
version.  Each becomes signed rows: a deletion takes the held count away, a revision takes
the held count away and adds the new one.  Signed rows are added up by source, language and
version before anything is stored, and totals are sums over all committed batches.

A store is a folder of two tables, each with a folder for each batch:

* `facts`: the documents' signed counts, from which a deletion learns what to take away;
* `totals`: the signed sums by source, language and version.

A batch is committed by the marker that Spark's writer leaves in its `totals` folder, which
is written last.  A batch that is sent again after that is skipped; one that broke off
before is not seen by any reader and is overwritten.  So each batch counts exactly once.

Cases: within a batch the last change of a document (by `seq`, then by the greatest op, source,
lang and tokens) holds; a null doc_id is a document of its own; deleting or revising
an unknown document takes nothing away (a revision then inserts); null source, language or
version form groups of their own; an empty batch commits no rows; rows that repeat a change
count once; null or empty texts have 0 tokens and still count as a document; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "version"]
FACT = "doc_id long, source string, lang string, version string, tokens long, docs int"
TOTAL = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[str]:
        """The committed batches, by name."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        marked = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName().removeprefix("batch=") for p in marked)

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{kind}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def held(self) -> DataFrame:
        """doc_id, source, lang, version, tokens of the documents that are present."""
        signed = self._read("facts", FACT).groupBy("doc_id", *GROUP)
        return signed.agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).where("docs > 0").drop("docs")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of the groups that have documents."""
        signed = self._read("totals", TOTAL).groupBy(*GROUP)
        return signed.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (seq, op, doc_id, source, lang, version, tokens); False if it was committed before.

        op is insert, revise or delete; a deletion's source, lang and tokens are not read.
        """
        if batch in self.batches():
            return False
        key = [F.col("doc_id"), F.col("version")]
        now = F.struct("op", "source", "lang", "tokens")
        last = changes.groupBy(*key).agg(F.max_by(now, F.struct("seq", now)).alias("now"))
        before = self.held().select(*key, F.struct("source", "lang", "tokens").alias("was"))
        both = last.join(before, (last.doc_id.eqNullSafe(before.doc_id)) & (last.version.eqNullSafe(before.version)), "left")
        plus = F.when(F.col("now.op") != "delete", _signed("now", 1))
        minus = F.when(F.col("was").isNotNull(), _signed("was", -1))
        signed = (
            both.select(last.doc_id, last.version, F.explode(F.array_compact(F.array(plus, minus))).alias("x"))
            .select("doc_id", "x.source", "x.lang", "version", "x.tokens", "x.docs")
        )
        facts = f"{self.path}/facts/batch={batch}"
        signed.write.mode("overwrite").parquet(facts)
        sums = self.spark.read.schema(FACT).parquet(facts).groupBy(*GROUP)
        sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).select("source", "lang", "version", "docs", "tokens")
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        return True


def _signed(of: str, sign: int):
    return F.struct(
        F.col(f"{of}.source").alias("source"),
        F.col(f"{of}.lang").alias("lang"),
        (sign * F.coalesce(F.col(f"{of}.tokens"), F.lit(0))).cast("long").alias("tokens"),
        F.lit(sign).alias("docs"),
    )


def changes(op: str, counted: DataFrame, seq: int = 0) -> DataFrame:
    """Changes of one kind from rows of `counted` (doc_id, source, lang, version, tokens)."""
    return counted.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "doc_id", *GROUP, "tokens")
