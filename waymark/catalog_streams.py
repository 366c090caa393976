"""Version streams and statements with named parameters as queries over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from waymark.catalog import _WITH, _paths, query
from waymark.operators import named
from waymark.plans import gazetteer as g
from waymark.plans.store import Scratch, read
from waymark.streaming import versions


@query(
    "refresh_state",
    """WITH m AS (SELECT DISTINCT o_orderstatus AS service, year(o_orderdate) AS y, strftime(o_orderdate, '%Y_%m') AS version FROM orders),
b AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS batch, 0 AS asked FROM (SELECT DISTINCT y FROM m)), e AS (SELECT * FROM b UNION ALL SELECT max(y), max(batch) + 1, 1 FROM b),
a AS (SELECT batch, service, e.y, asked, max(version) AS version, count(*) AS ticks FROM e JOIN m ON m.y <= e.y GROUP BY ALL)
SELECT CAST(batch AS BIGINT) AS batch, service, version, ticks, CAST(asked AS BIGINT) AS demands, CASE WHEN asked = 1 AND y % 3 <> 0 THEN 'current' WHEN asked = 0 AND y % 3 = 0 THEN 'failed' ELSE 'published' END AS outcome FROM a""",
)
def refresh_state(spark, sf_dir):
    """A batch a year announces versions of three services; the first build of some fails, and the last batch asks again."""
    scratch = Scratch(spark, "state")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("service"), F.date_format("o_orderdate", "yyyy_MM").alias("version"), F.year("o_orderdate").alias("y"), "o_orderkey")
    seen = orders.select("service", "version", "y").distinct().withColumn("kind", F.lit("tick"))
    seen = scratch.table(seen, "seen")
    write = lambda df: df.select("service", "kind", "version").coalesce(1).write.mode("append").json(f"{scratch.path}/events")
    for r in seen.select("y").distinct().orderBy("y").collect():  # a file a year
        write(seen.where(F.col("y") == r["y"]))
    write(seen.select("service", F.lit("demand").alias("kind"), F.lit(None).cast("string").alias("version")).distinct())
    tried = set()

    def build(service: str, version: str):
        if int(version[:4]) % 3 == 0 and (service, version) not in tried:
            tried.add((service, version))
            raise RuntimeError("the first build of this version fails")
        return {"orders": orders.where((F.col("service") == service) & (F.col("version") == version)).select("o_orderkey")}

    versions.keep_current(spark, f"{scratch.path}/events", f"{scratch.path}/saved", build, f"{scratch.path}/seen-by", f"{scratch.path}/log").awaitTermination()
    return spark.read.schema(versions.LOG).parquet(f"{scratch.path}/log/at=*")


@query(
    "late_subscribers",
    """WITH v AS (SELECT DISTINCT strftime(ts, '%Y_%m_%d') AS version, date_trunc('day', ts) + INTERVAL 12 HOUR AS moment FROM events), u AS (SELECT user_id, min(ts) AS since FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS subscriber, version FROM u JOIN v ON moment > since UNION ALL SELECT CAST(user_id AS VARCHAR), arg_max(version, moment) FROM u JOIN v ON moment <= since GROUP BY user_id""",
)
def late_subscribers(spark, sf_dir):
    """Every user subscribes with the first event; a version a day, in three files of ten days."""
    scratch = Scratch(spark, "subscribers")
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.date_trunc("day", "ts")
    changes = events.select(F.lit("version").alias("kind"), F.date_format("ts", "yyyy_MM_dd").alias("who"), (day + F.expr("interval 12 hours")).alias("at")).distinct()
    notes = changes.unionByName(events.groupBy(F.col("user_id").cast("string").alias("who")).agg(F.min("ts").alias("at")).withColumn("kind", F.lit("subscribe")))
    notes = scratch.table(notes.withColumn("part", F.floor((F.dayofyear("at") - 1) / 10)), "notes")
    for r in notes.select("part").distinct().orderBy("part").collect():  # a file ten days
        notes.where(F.col("part") == r["part"]).select("kind", "who", "at").coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{scratch.path}/events")
    versions.deliver(spark, f"{scratch.path}/events", f"{scratch.path}/store", f"{scratch.path}/seen-by").awaitTermination()
    return spark.read.parquet(f"{scratch.path}/store/deliveries").select("subscriber", "version")


@query(
    "named_lookup",
    f"""{_WITH} SELECT code, typ, address FROM addr WHERE typ IN (105, 108) AND code BETWEEN 105000000 AND 108000900 AND address <> 'it''s :none' AND (lat IS NULL OR lat >= 300010.5)
UNION ALL SELECT -1, (SELECT count(*) FROM addr), 'o''clock' FROM region WHERE r_regionkey = 0""",
)
def named_lookup(spark, sf_dir):
    """Typed parameters, a list, nulls and quotes, and one value read by a statement of its own."""
    records = g.address(_paths(spark, sf_dir), ("lks_koord",))
    found = named.run(
        spark,
        "select code, typ, address from {records} where array_contains(:types, typ) and code between :low and :high and address <> :never and (:name is null or address = :name) and (lksLat is null or lksLat >= :lat)",
        {"types": [g.PAG, g.NLT], "low": 105_000_000, "high": 108_000_900, "never": "it's :none", "name": None, "lat": 300010.5},
        {"name": "string", "types": "array<int>"},
        records=records,
    )
    every = named.value(spark, "select count(*) as n from {records} where :day > date'2000-01-01'", {"day": datetime.date(2024, 1, 1)}, records=records)
    return found.unionByName(named.run(spark, "select -1L as code, cast(:n as int) as typ, :text as address", {"n": every, "text": "o'clock"}))
