"""Written tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()
_left: dict[str, Scratch] = {}


@atexit.register
def _drop_all() -> None:
    for scratch in list(_left.values()):
        with contextlib.suppress(Exception):  # the session may have ended
            if scratch.spark.sparkContext._jsc is not None:
                scratch.drop()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Where the setting is absent, a local master gets a folder of its own under
    /tmp/checkpoints; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/checkpoints/waymark-{os.getpid()}"
    if own not in _own:
        _own.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


class Scratch:
    """Tables that one operator call writes to cut its lineage.

    They must outlive the lazily read result, so whoever has consumed that
    result calls drop(), as the pipeline does between its stages; what is left goes when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _left[self.path] = self

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes a step of a longer plan and goes on from what was written."""
        self._n += 1
        return self.table(df, f"step{self._n}")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def drop(self) -> None:
        _left.pop(self.path, None)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
