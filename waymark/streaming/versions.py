"""Versions as a stream: state of what was announced, builds that may fail and are tried again, and deliveries to subscribers.

events (files of JSON lines): service, kind (tick: a version was seen; demand: somebody asks for a check), version.
What was announced is the stream's checkpointed state; what is current is the snapshots' pointer; so a
restart at any point goes on from both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from waymark.sources import sinks

EVENTS = "service string, kind string, version string"
LOG = "batch bigint, service string, version string, ticks bigint, demands bigint, outcome string"


def announced(events: DataFrame) -> DataFrame:
    """service, version (the greatest so far), ticks, demands: a row a service, by the stream's state."""
    return events.groupBy("service").agg(F.max("version").alias("version"), F.count_if(F.col("kind") == "tick").alias("ticks"), F.count_if(F.col("kind") == "demand").alias("demands"))


def keep_current(spark: SparkSession, events_dir: str, root: str, build: Callable[[str, str], dict[str, DataFrame]], checkpoint: str, log: str, interval: str | None = None, files: int = 1) -> StreamingQuery:
    """Builds a service's newest version whenever events come and it is not current yet.

    build(service, version) gives the snapshot's tables.  Its failure leaves the old version current, and the next event of any
    kind tries the then newest again. Each attempt is a row of ``log``; a batch that is run again writes its rows in place of the first ones.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        done = []
        for r in batch.orderBy("service").collect():  # a row a service
            at = f"{root}/{r['service']}"
            now = sinks.current_version(spark, at)
            if r["version"] is None or (now is not None and now >= r["version"]):
                done.append((number, *r, "current"))
                continue
            try:
                sinks.save_snapshot(build(r["service"], r["version"]), at, r["version"])
                done.append((number, *r, "published"))
            except Exception:  # whatever a build can raise
                done.append((number, *r, "failed"))
        spark.createDataFrame(done, LOG).coalesce(1).write.mode("overwrite").parquet(f"{log}/at={number}")

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files)).json(events_dir)
    writer = announced(events).writeStream.outputMode("complete").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def deliver(spark: SparkSession, notes_dir: str, store: str, checkpoint: str, interval: str | None = None, files: int = 1) -> StreamingQuery:
    """Deliveries of versions to subscribers, from files of JSON lines: kind (version or subscribe), who (subscriber or version), at (timestamp).

    A subscriber gets the version that was current when it came, once, and every later one. Files come in order of
    time; within a batch times decide. Under ``store``: subscribers, versions and deliveries (subscriber, version, at), a folder a
    batch, so a batch that is run again replaces its own.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        write = lambda df, table: df.write.mode("overwrite").parquet(f"{store}/{table}/batch={number}")
        came = batch.where("kind = 'subscribe'").groupBy(F.col("who").alias("subscriber")).agg(F.min("at").alias("since"))
        fresh = batch.where("kind = 'version'").groupBy(F.col("who").alias("version")).agg(F.min("at").alias("at"))
        known, old = _before(spark, f"{store}/subscribers", number, came), _before(spark, f"{store}/versions", number, fresh)
        write(came.join(known, "subscriber", "left_anti"), "subscribers")
        write(fresh.join(old, "version", "left_anti"), "versions")
        came, fresh = (spark.read.schema(d.schema).parquet(f"{store}/{t}/batch={number}") for d, t in ((came, "subscribers"), (fresh, "versions")))
        last = old.agg(F.max_by(F.struct("at", "version"), F.struct("at", "version")).alias("v")).where("v is not null").select("v.version", "v.at")
        # One row: the versions of a batch, which come a few at a time.
        listed = lambda v: F.broadcast(v.agg(F.sort_array(F.collect_list(F.struct("at", "version"))).alias("all")).withColumn("one", F.lit(1)))
        later = F.filter("all", lambda v: v["at"] > F.col("since"))
        current = F.try_element_at(F.filter("all", lambda v: v["at"] <= F.col("since")), F.lit(-1))
        to_known = known.withColumn("one", F.lit(1)).join(listed(fresh), "one").select("subscriber", F.explode(later).alias("v"))
        own = F.concat(F.filter(F.array(current), lambda v: v.isNotNull()), later)
        to_new = came.withColumn("one", F.lit(1)).join(listed(fresh.unionByName(last)), "one").select("subscriber", F.explode(own).alias("v"))
        write(to_known.unionByName(to_new).select("subscriber", "v.version", "v.at"), "deliveries")

    notes = spark.readStream.schema("kind string, who string, at timestamp").option("maxFilesPerTrigger", str(files)).json(notes_dir)
    writer = notes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _before(spark: SparkSession, table: str, number: int, like: DataFrame) -> DataFrame:
    """What the batches before one have written."""
    if number == 0:
        return like.limit(0)
    own = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(own).parquet(table).where(F.col("batch") < number).drop("batch")
