"""The adaptive tree: leaves within their bound, clusters with far points, work that follows the points."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waymark.operators import spatial

POINTS, ASKED = "code bigint, lat decimal(10,3), long decimal(10,3)", "q_id bigint, lat decimal(10,3), long decimal(10,3)"


def cluster(n, seed):
    """All in ten metres, but two far points and one heap of equal ones."""
    rng = random.Random(seed)
    near = lambda: Decimal(rng.randint(0, 10_000)) / 1000 + 300_000
    rows = [(i, near(), near()) for i in range(n)]
    return rows + [(n, Decimal(449_999), Decimal(769_999)), (n + 1, Decimal(-5), Decimal(-7))] + [(n + 2 + i, Decimal(300_001), Decimal(300_001)) for i in range(n // 4)]


@pytest.mark.parametrize("most_broadcast", [0, 100_000])
def test_leaves_and_answers_of_a_cluster(spark, most_broadcast):
    rows = cluster(1200, 1)
    points = spark.createDataFrame(rows, POINTS)
    tree = spatial.build(points, 5, leaf_points=20, most_broadcast=most_broadcast)
    leaves = tree.leaves.select("node", F.size("points").alias("n"), F.explode("points.code").alias("code")).collect()
    kept = {c for c, *_ in rows if c <= 1201} | set(range(1202, 1207))
    assert {r["code"] for r in leaves} == kept and len(leaves) == len(kept)
    assert max(r["n"] for r in leaves) <= 20
    assert sum(tree.sizes) < 8 * len(kept) / 20 + 60
    rng = random.Random(2)
    asked = [(i, Decimal(rng.randint(-1000, 11_000)) / 1000 + 300_000, Decimal(rng.randint(-1000, 11_000)) / 1000 + 300_000) for i in range(60)] + [(100, Decimal(440_000), Decimal(1)), (101, Decimal(300_001), Decimal(300_001))]
    got = {}
    for r in spatial.nearest(points, spark.createDataFrame(asked, ASKED), 5, leaf_points=20, most_broadcast=most_broadcast).orderBy("q_id", "place").collect():
        got.setdefault(r["q_id"], []).append((r["distance"], r["code"]))
    for q, x, y in asked:
        assert got[q] == sorted(((a - x) ** 2 + (b - y) ** 2, c) for c, a, b in rows)[:5]


def test_queries_meet_few_points(spark):
    """Of 20,000 points in one spot a query meets some leaves, beside one far point."""
    spot = lambda seed: (F.rand(seed) * 10 + 300_000).cast("decimal(10,3)")
    far = lambda c, x: F.when(F.col("id") == 0, F.lit(x)).otherwise(c).cast("decimal(10,3)")
    points = spark.range(20_000).select(F.col("id").alias("code"), far(spot(1), 440_000).alias("lat"), far(spot(2), 760_000).alias("long"))
    asked = spark.range(2000).select(F.col("id").alias("q_id"), spot(3).alias("lat"), spot(4).alias("long"))
    tree = spatial.build(points, 5)
    home = spatial._home(asked, tree, 5)
    assert home.where("leaf is not null").count() > 1900
    own = spatial._measured(home.where("leaf is not null").select("q_id", "qx", "qy", F.col("leaf").alias("node")), tree, 5, False)
    reach = home.join(own.where("place = 5").select("q_id", F.col("distance").alias("reach")), "q_id")
    assert spatial._within(reach, tree, "met").count() <= 8 * 2000
    assert spatial.nearest(points, asked, 5).count() == 10_000


def test_equal_distances_of_a_circle(spark):
    """Four points at one distance are one for a unique search, which then looks further."""
    rows = [(4 * d + i, Decimal(x * d), Decimal(y * d)) for d in range(1, 40) for i, (x, y) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1)))]
    asked = spark.createDataFrame([(1, Decimal(0), Decimal(0))], ASKED)
    got = spatial.nearest(spark.createDataFrame(rows, POINTS), asked, 20, unique_distance=True, leaf_points=8).orderBy("place").collect()
    assert [(r["code"], r["distance"]) for r in got] == [(4 * d, d * d) for d in range(1, 21)]
