"""Fetched files and archives as queries; both are written from the driver's tables first, where a local path can be read."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalog import _WITH, query
from waymark.plans import gazetteer as g
from waymark.plans.store import Scratch, read
from waymark.sources.fetched import ArchiveLines, FetchedLines


def _files(spark, at: str) -> list[str]:
    """URLs of the files with text under a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [f"file://{s.getPath().toUri().getPath()}" for s in found if s.getPath().getName().startswith("part-") and s.getLen()]


@query("fetched_files", "SELECT concat_ws(';', o_orderkey, o_custkey, o_orderstatus) AS value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS line FROM orders")
def fetched_files(spark, sf_dir):
    """Lines of a file for each status of orders, a task a file."""
    orders = read(spark, sf_dir, "orders")
    at = f"{Scratch(spark, 'fetched').path}/orders"
    lines = orders.select("o_orderstatus", "o_orderkey", F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    urls: list[str] = []
    for status in [r[0] for r in orders.select("o_orderstatus").distinct().collect()]:  # three
        lines.where(F.col("o_orderstatus") == status).repartition(1).sortWithinPartitions("o_orderkey").select("value").write.text(f"{at}/{status}")
        urls += _files(spark, f"{at}/{status}")
    spark.dataSource.register(FetchedLines)
    return spark.read.format("waymark_lines").option("urls", " ".join(urls)).load().select("value", "line")


def _archive(spark, sf_dir) -> str:
    """A zip archive with an entry for each type of object but flats, ';' between values that '#' encloses."""
    path = f"{Scratch(spark, 'zip').path}/objects.zip".removeprefix("file:")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    path = "/" + path.lstrip("/")
    gaz = g.synthetic(spark, sf_dir).where(F.col("typ") != g.DZI)
    wrapped = F.concat_ws(";", *[F.concat(F.lit("#"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("#")) for c in ("code", "typ", "name", "super_code")])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for typ in (g.NOV, g.PAG, g.CIE, g.NLT):
            with z.open(f"objects/{typ}.csv", "w") as entry:
                for r in gaz.where(F.col("typ") == typ).select(wrapped.alias("value")).toLocalIterator():
                    entry.write(r["value"].encode() + b"\r\n")
    return f"file://{path}"


@query("archive_entries", f"{_WITH} SELECT code, typ, name, super_code, 'objects/' || typ || '.csv' AS entry FROM gaz WHERE typ <> 109")
def archive_entries(spark, sf_dir):
    """Objects from an archive's entries, a task an entry."""
    spark.dataSource.register(ArchiveLines)
    lines = spark.read.format("waymark_archive").option("url", _archive(spark, sf_dir)).load()
    return unwrapped(lines)


def unwrapped(lines: DataFrame) -> DataFrame:
    """Values of lines, each without the character that encloses it."""
    v = F.transform(F.split("value", ";"), lambda x: F.nullif(F.substr(x, F.lit(2), F.length(x) - 2), F.lit("")))
    kinds = {"code": "bigint", "typ": "int", "name": "string", "super_code": "bigint"}
    return lines.select(*[F.get(v, F.lit(i)).cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())], F.col("name").alias("entry"))
