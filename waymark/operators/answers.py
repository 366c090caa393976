"""A batch of requests, each answered by its own branch: code, text or coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import filters, search, spatial


def answer(queries: DataFrame, index: search.Index, ranked: DataFrame, codes: DataFrame, points: DataFrame, allowed: DataFrame | None = None, text_limit: int = 20, near_limit: int = 1) -> DataFrame:
    """q_id, route, place, code of queries (q_id, text, lat, long); those that fit no branch have no rows.

    codes: code of every object; points: code, lat, long.  Each branch is one join or search for
    all of its queries.
    """
    routed = index.scratch.keep(queries.withColumn("route", filters.route(F.col("text"), F.col("lat"), F.col("long"))))
    of = lambda name: routed.where(F.col("route") == name)
    by_code = of("code").select("q_id", F.col("text").cast("bigint").alias("code")).join(codes.select("code"), "code").select("q_id", F.lit(1).alias("place"), "code")
    by_text = search.search(of("text").select("q_id", "text"), index, ranked, allowed, text_limit).select("q_id", "place", "code")
    near = points if allowed is None else points.join(allowed.select("code"), "code", "left_semi")
    by_place = spatial.nearest(near, of("nearest").select("q_id", "lat", "long"), near_limit).select("q_id", "place", "code")
    parts = [d.select("q_id", F.lit(n).alias("route"), "place", "code") for n, d in (("code", by_code), ("text", by_text), ("nearest", by_place))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
