"""A saved index that takes changes: deltas beside a version, read as one, compacted on demand.

A delta has the strings that changed (text null: removed), the postings of their new texts, and what they
change in the vocabulary.  Of a string only its last delta counts, and the version's own postings of it no longer do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.search import Index
from waymark.plans import index as plan
from waymark.plans.store import Scratch
from waymark.sources import sinks

#: Changed strings, two numbers each, that are broadcast; more are shuffled.
MOST_BROADCAST = 500_000


def _deltas(spark: SparkSession, root: str, version: str) -> list[int]:
    """Numbers of the version's deltas that are whole: a delta's marker is written last."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{version}/deltas")
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(base):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(base) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "done/_SUCCESS")))


def _read(spark: SparkSession, root: str, version: str, numbers: list[int], table: str) -> DataFrame:
    parts = [spark.read.parquet(f"{root}/{version}/deltas/{n}/{table}").withColumn("delta", F.lit(n)) for n in numbers]
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, root: str, version: str | None = None) -> Index:
    """The version with all its deltas."""
    version = version or sinks.current_version(spark, root)
    base = Index.load(spark, root, version)
    numbers = _deltas(spark, root, version)
    if not numbers:
        return base
    strings = _read(spark, root, version, numbers, "strings")
    last = strings.groupBy("idx").agg(F.max("delta").alias("delta"))
    if strings.count() <= MOST_BROADCAST:
        last = F.broadcast(last)
    fresh = _read(spark, root, version, numbers, "posting").join(last, ["idx", "delta"], "left_semi")
    names = ["mult", "token", "idx", "exact"]
    posting = base.posting.join(last.select("idx"), "idx", "left_anti").select(*names).unionByName(fresh.select(*names))
    both = base.vocab.select("mult", "token", "n_exact", "n_approx").unionByName(_read(spark, root, version, numbers, "vocab").select("mult", "token", "n_exact", "n_approx"))
    vocab = both.groupBy("mult", "token").agg(F.sum("n_exact").alias("n_exact"), F.sum("n_approx").alias("n_approx")).where("n_exact + n_approx > 0")
    now = strings.join(last, ["idx", "delta"], "left_semi").where("text is not null")
    texts = base.strings.join(last.select("idx"), "idx", "left_anti").select("idx", "code", "text").unionByName(now.select("idx", "code", "text"))
    return Index(posting, vocab, texts, Scratch(spark, "index"))


def apply(spark: SparkSession, root: str, changes: DataFrame, synonyms: DataFrame | None = None, version: str | None = None) -> int:
    """Writes changes (idx, code, text; text null removes) as the version's next delta and returns its number.

    Of several changes of one string the greatest text counts.  A delta that was not written whole is ignored and its number used again.
    """
    version = version or sinks.current_version(spark, root)
    number = max(_deltas(spark, root, version), default=0) + 1
    at = f"{root}/{version}/deltas/{number}"
    write = lambda df, table: df.write.mode("overwrite").parquet(f"{at}/{table}")
    write(changes.groupBy("idx").agg(F.max_by(F.struct("code", "text"), F.coalesce("text", F.lit(""))).alias("s")).select("idx", "s.code", "s.text"), "strings")
    strings = spark.read.parquet(f"{at}/strings")
    write(plan.postings(strings.where("text is not null").select("idx", "text"), synonyms), "posting")
    touched = strings.select("idx")
    if strings.count() <= MOST_BROADCAST:
        touched = F.broadcast(touched)
    gone = load(spark, root, version).posting.join(touched, "idx", "left_semi").select("token", "mult", "exact", F.lit(-1).alias("by"))
    came = spark.read.parquet(f"{at}/posting").select("token", "mult", "exact", F.lit(1).alias("by"))
    count = lambda exact: F.sum(F.when(F.col("exact") == exact, F.col("by")).otherwise(0)).cast("bigint")
    write(gone.unionByName(came).groupBy("mult", "token").agg(count(True).alias("n_exact"), count(False).alias("n_approx")), "vocab")
    write(spark.createDataFrame([(number,)], "delta int"), "done")
    return number


def compact(spark: SparkSession, root: str, version: str) -> Index:
    """Writes the current version and its deltas as a new version without any, and makes that current."""
    load(spark, root).save(root, version)
    return Index.load(spark, root, version)
