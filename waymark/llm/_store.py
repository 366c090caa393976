"""Tables in the folder that all executors share, and how many rows a task takes at a time."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans import store
from waymark.plans.store import Scratch, shared_dir

__all__ = ["BATCH_ROWS", "Scratch", "bounded_batches", "join_salted", "join_split", "read", "shared_dir"]

#: Spark hands rows to Python by count, 10000 unless set; texts can be long, so fewer keep a task's memory bounded.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return store.read(spark, sf_dir, table)


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, most: int = 2000) -> DataFrame:
    """Inner join of ``rows``, ``total`` or fewer, with written ``groups``, unique by ``keys`` and with the number of their rows as ``many``.

    Groups of more than 1 / ``most`` of ``total``, so at most ``most`` of them, are broadcast and never
    meet in one task; the others are shuffled.
    """
    bar = max(1000, total // most)
    if (groups.agg(F.max("many")).first()[0] or 0) <= bar:
        return rows.join(groups, keys)
    hot = groups.where(F.col("many") > bar)
    apart = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col("many") <= bar), keys)
    return apart.unionByName(rest)


def join_salted(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, total: int, most: int = 2000) -> DataFrame:
    """As ``join_split``, for groups with several rows a key, each with ``many``, the number of ``rows`` of the key.

    A key's rows are dealt by ``spread`` to many * ``most`` / ``total`` parts, and each part gets the key's groups.
    """
    bar = max(1000, total // most)
    if (groups.agg(F.max("many")).first()[0] or 0) <= bar:
        return rows.join(groups, keys)
    parts = groups.where(F.col("many") > bar).groupBy(*keys).agg(F.ceil(F.max("many") / bar).cast("int").alias("parts"))  # ``most`` rows at most
    dealt = rows.join(F.broadcast(parts), keys, "left").withColumn("salt", F.pmod(spread, F.coalesce("parts", F.lit(1)))).drop("parts")
    copied = groups.join(F.broadcast(parts), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1))).drop("parts")
    return dealt.join(copied, [*keys, "salt"]).drop("salt")
