"""Refresh of a snapshot when a newer version appears."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.sources import sinks


def newest(versions: DataFrame, current: str | None) -> str | None:
    """The greatest version, if it is newer than the current one."""
    top = versions.agg(F.max("version")).first()[0]
    return top if top is not None and (current is None or top > current) else None


def watch(spark: SparkSession, versions_dir: str, root: str, build: Callable[[str], dict[str, DataFrame]], checkpoint: str, published: Callable[[str], None] | None = None, interval: str | None = None) -> StreamingQuery:
    """Follows files of lines (version names); a newer one is built, saved and made current.

    A failed build leaves the current snapshot; the checkpoint holds what was seen.
    Without an interval all that is there is taken once.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        version = newest(batch, sinks.current_version(spark, root))
        if version is None:
            return
        sinks.save_snapshot(build(version), root, version)
        if published:
            published(version)

    stream = spark.readStream.text(versions_dir).select(F.trim("value").alias("version")).where("version <> ''")
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest_by_type(spark: SparkSession, path: str, schema, name: str, checkpoint: str) -> DataFrame:
    """The newest event of each type, kept by a stream over event files."""
    events = spark.readStream.schema(schema).parquet(path)
    top = events.groupBy("event_type").agg(F.max("ts").alias("latest"), F.count("*").alias("n_events"))
    top.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
