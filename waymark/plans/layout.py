"""An index saved for look-ups: postings in buckets by (mult, token), parted by class of object.

A join with them on (mult, token) shuffles the queries alone.  Searches that ask only for cities,
municipalities, parishes and villages read the part of those objects and a vocabulary of their own: an index of big objects without a second copy.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import filters
from waymark.operators.search import Index
from waymark.plans import gazetteer as g
from waymark.plans import index as plan
from waymark.plans.store import Scratch
from waymark.sources import sinks

_POSTING = "idx bigint, exact boolean, mult int, token string, big boolean"


def save(index: Index, objects: DataFrame, root: str, version: str, buckets: int | None = None, big: tuple[int, ...] = g.BIG) -> None:
    """Writes the index as a version and makes it current. objects: code, typ; strings without an object are not big."""
    spark = objects.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{root}/{version}"
    classes = plan.big_only(index.strings, objects, big).select("idx").distinct().withColumn("big", F.lit(True))
    posting = index.posting.join(classes, "idx", "left").select("idx", "exact", F.col("mult").cast("int").alias("mult"), "token", F.coalesce("big", F.lit(False)).alias("big"))
    name = f"waymark_{uuid.uuid4().hex}"
    dealt = posting.repartition(buckets, "mult", "token")  # one task a bucket, so one file a bucket and class
    dealt.write.mode("overwrite").format("parquet").partitionBy("big").bucketBy(buckets, "mult", "token").sortBy("mult", "token", "idx").option("path", f"{at}/posting").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    written = spark.read.schema(_POSTING).parquet(f"{at}/posting")
    plan.vocabulary(written.where("big")).write.mode("overwrite").parquet(f"{at}/vocab_big")
    shape = spark.createDataFrame([(buckets,)], "buckets int")
    sinks.save_snapshot({"vocab": index.vocab, "strings": index.strings, "shape": shape}, root, version)


def load(spark: SparkSession, root: str, version: str | None = None, types: list[int] | None = None) -> Index:
    """A saved version; where all types asked for are big ones, only what big objects have."""
    tables = sinks.load_snapshot(spark, root, ["vocab", "strings", "shape"], version)
    at = f"{root}/{version or sinks.current_version(spark, root)}"
    buckets = tables["shape"].first()["buckets"]
    name = f"waymark_{zlib.crc32(at.encode()):08x}"
    spark.sql(f"create table if not exists {name} ({_POSTING}) using parquet partitioned by (big) clustered by (mult, token) sorted by (mult, token, idx) into {buckets} buckets location '{at}/posting'")
    spark.sql(f"alter table {name} recover partitions")
    posting = spark.table(name)
    if not filters.uses_big_index(types):
        return Index(posting, tables["vocab"], tables["strings"], Scratch(spark, "index"))
    return Index(posting.where("big"), spark.read.parquet(f"{at}/vocab_big"), tables["strings"], Scratch(spark, "index"))
