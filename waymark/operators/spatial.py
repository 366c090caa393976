"""Nearest objects in the plane, for a batch of query points, over an adaptive tree.

points: code, lat, long (decimal).  Distances are squared, as decimals, so equal ones are
equal; ties go by code.

The tree parts the plane at quantiles of the points themselves, up to FAN ways at a time along the axis
that its points divide better, until no leaf has more than ``leaf_points``.  A town and an empty
stretch so have leaves of the same size, and a far point costs one more step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.plans.store import Scratch

FAN = 16
#: Queries of one leaf that a task answers.
LEAF_QUERIES = 2000


def squared_distance(lat: Column, long: Column, to_lat: Column, to_long: Column) -> Column:
    dx, dy = lat - to_lat, long - to_long
    return dx * dx + dy * dy


def _square(x: Column) -> Column:
    return x * x


@dataclass
class Tree:
    """nodes: node, level, parent, place (among its parent's children), n, x0, x1, y0, y1 (box of its points), by_lat, bounds (none
    in a leaf); leaves: node, points (code, lat, long of each).  Nodes of a level are joined by a broadcast up to ``most_broadcast`` of them."""

    nodes: list[DataFrame]
    sizes: list[int]
    leaves: DataFrame
    scratch: Scratch
    most_broadcast: int

    def level(self, i: int) -> DataFrame:
        return F.broadcast(self.nodes[i]) if self.sizes[i] <= self.most_broadcast else self.nodes[i]


def _child(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= value))


def build(points: DataFrame, per_place: int, leaf_points: int = 128, most_broadcast: int = 100_000, scratch: Scratch | None = None) -> Tree:
    """The tree of points (code, lat, long); of one place the ``per_place`` smallest codes take part.

    A round parts all nodes that are too large; quantiles are approximate, boxes and counts exact.
    """
    scratch = scratch or Scratch(points.sparkSession, "tree")
    same_place = F.row_number().over(Window.partitionBy("lat", "long").orderBy("code"))
    own = points.where("lat is not null and long is not null").select("code", "lat", "long").withColumn("_k", same_place).where(F.col("_k") <= per_place).drop("_k")
    kind = dict(own.dtypes)["lat"]
    cuts = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    active = own.withColumn("parent", F.lit(-1).cast("bigint")).withColumn("place", F.lit(0))
    levels, sizes, leaves = [], [], None
    while True:
        n = len(levels)
        active = scratch.table(active, f"points-{n}")
        box = [f(c).alias(a) for c, lo, hi in (("lat", "x0", "x1"), ("long", "y0", "y1")) for f, a in ((F.min, lo), (F.max, hi))]
        stats = active.groupBy("parent", "place").agg(F.count("*").alias("n"), *box, F.percentile_approx("lat", cuts, 1000).alias("qx"), F.percentile_approx("long", cuts, 1000).alias("qy"))

        def inner(q: str, low: str, high: str, kind: str = kind) -> Column:
            """Quantiles above the least value; where there are none, the middle, or the greatest value."""
            some = F.array_sort(F.array_distinct(F.filter(q, lambda b: b > F.col(low))))
            middle = ((F.col(low) + F.col(high)) / 2).cast(kind)
            return F.when(F.size(some) > 0, some).otherwise(F.array(F.when(middle > F.col(low), middle).otherwise(F.col(high))))

        done = (F.col("n") <= max(leaf_points, per_place)) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))
        flat_x, flat_y = F.col("x0") == F.col("x1"), F.col("y0") == F.col("y1")
        bx, by = inner("qx", "x0", "x1"), inner("qy", "y0", "y1")
        wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
        by_lat = F.when(flat_x, F.lit(False)).when(flat_y, F.lit(True)).when(F.size(bx) == F.size(by), wide).otherwise(F.size(bx) > F.size(by))
        number = F.lit(n).cast("bigint") * F.lit(1 << 50) + F.monotonically_increasing_id()
        nodes = stats.withColumn("by_lat", by_lat).withColumn("bounds", F.when(~done, F.when(F.col("by_lat"), bx).otherwise(by))).drop("qx", "qy")
        nodes = scratch.table(nodes.withColumn("node", number).withColumn("level", F.lit(n)), f"nodes-{n}")
        count = nodes.agg(F.count("*").alias("all"), F.count("bounds").alias("inner")).first()
        levels.append(nodes)
        sizes.append(count["all"])
        placed = active.join(F.broadcast(nodes) if count["all"] <= most_broadcast else nodes, ["parent", "place"]).select("node", "code", "lat", "long", "by_lat", "bounds")
        full = placed.where("bounds is null").select("node", "code", "lat", "long")
        leaves = full if leaves is None else leaves.unionByName(full)
        if not count["inner"]:
            break
        at = F.when(F.col("by_lat"), F.col("lat")).otherwise(F.col("long"))
        active = placed.where("bounds is not null").select("code", "lat", "long", F.col("node").alias("parent"), _child(at, F.col("bounds")).alias("place"))
    packed = leaves.groupBy("node").agg(F.collect_list(F.struct("code", "lat", "long")).alias("points"))  # a leaf's bound each
    return Tree(levels, sizes, scratch.table(packed, "leaves"), scratch, most_broadcast)


def _home(asked: DataFrame, tree: Tree, k: int) -> DataFrame:
    """q_id, qx, qy, leaf (or null), bars: for each node on a query's way with k points or more the distance within which all of them lie."""
    way = asked.select("q_id", F.col("lat").alias("qx"), F.col("long").alias("qy"), F.lit(-1).cast("bigint").alias("parent"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("leaf"))
    zero = squared_distance(F.col("qx"), F.col("qy"), F.col("qx"), F.col("qy"))
    way = way.withColumn("bars", F.filter(F.array(zero), lambda x: F.lit(False)))
    for i in range(len(tree.nodes)):
        box = tree.level(i).select("parent", "place", "node", "n", "x0", "x1", "y0", "y1", "by_lat", "bounds")
        met = way.join(box, ["parent", "place"], "left")
        far = _square(F.greatest(F.abs(F.col("qx") - F.col("x0")), F.abs(F.col("qx") - F.col("x1")))) + _square(F.greatest(F.abs(F.col("qy") - F.col("y0")), F.abs(F.col("qy") - F.col("y1"))))
        bars = F.when(F.col("n") >= k, F.concat("bars", F.array(far))).otherwise(F.col("bars"))
        at = F.when(F.col("by_lat"), F.col("qx")).otherwise(F.col("qy"))
        leaf = F.when(F.col("node").isNotNull() & F.col("bounds").isNull(), F.col("node")).otherwise(F.col("leaf"))
        way = met.select("q_id", "qx", "qy", F.when(F.col("bounds").isNotNull(), F.col("node")).otherwise(F.lit(-2)).alias("parent"), F.when(F.col("bounds").isNotNull(), _child(at, F.col("bounds"))).otherwise(F.lit(0)).alias("place"), leaf.alias("leaf"), bars.alias("bars"))
    return way.select("q_id", "qx", "qy", "leaf", "bars")


def _within(asked: DataFrame, tree: Tree, name: str) -> DataFrame:
    """q_id, qx, qy, node: the leaves that reach into a query's reach (squared; all of them without one)."""
    front, found = asked.select("q_id", "qx", "qy", "reach", F.lit(-1).cast("bigint").alias("parent")), None
    for i in range(len(tree.nodes)):
        box = tree.level(i).select("parent", "node", "x0", "x1", "y0", "y1", F.col("bounds").isNull().alias("is_leaf"))
        near = lambda q, lo, hi: F.greatest(F.col(lo) - F.col(q), F.col(q) - F.col(hi), F.col(q) - F.col(q))
        met = front.join(box, "parent").where(F.col("reach").isNull() | (_square(near("qx", "x0", "x1")) + _square(near("qy", "y0", "y1")) <= F.col("reach")))
        met = met.select("q_id", "qx", "qy", "reach", "node", "is_leaf")
        if i > 1:  # each level reads the one above twice
            met = tree.scratch.table(met, f"{name}-{i}")
        leaf = met.where("is_leaf").select("q_id", "qx", "qy", "node")
        found = leaf if found is None else found.unionByName(leaf)
        front = met.where("not is_leaf").select("q_id", "qx", "qy", "reach", F.col("node").alias("parent"))
    return found


def _measured(pairs: DataFrame, tree: Tree, k: int, unique_distance: bool) -> DataFrame:
    """q_id, place, code, distance of the k nearest points in each query's leaves (q_id, qx, qy, node); leaves of many queries are dealt to several tasks."""
    hot = pairs.groupBy("node").agg(F.ceil(F.count("*") / LEAF_QUERIES).cast("int").alias("_parts")).where("_parts > 1")
    if sum(tree.sizes) <= tree.most_broadcast:  # two numbers a leaf
        hot = F.broadcast(hot)
    salted = pairs.join(hot, "node", "left").withColumn("_part", F.pmod(F.xxhash64("q_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = tree.leaves.join(hot, "node", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = salted.join(copies, ["node", "_part"])
    rows = met.select("q_id", "qx", "qy", F.explode("points").alias("p")).select("q_id", F.col("p.code").alias("code"), squared_distance(F.col("p.lat"), F.col("p.long"), F.col("qx"), F.col("qy")).alias("distance"))
    if unique_distance:
        rows = rows.groupBy("q_id", "distance").agg(F.min("code").alias("code"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "code"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("q_id", "place", "code", "distance")


def nearest(points: DataFrame, queries: DataFrame, k: int, unique_distance: bool = False, scratch: Scratch | None = None, leaf_points: int = 128, most_broadcast: int = 100_000) -> DataFrame:
    """q_id, place, code, distance of the k nearest points of each query (q_id, lat, long); fewer if there are fewer.

    unique_distance: of points at one distance only the smallest code counts.

    A query first meets its own leaf, whose k-th distance bounds the answer (a leaf with fewer than k is bounded by
    the box of the last node above it with k points), and then the leaves within that bound.  At most k points of one place
    (the smallest codes) take part, so heaps of equal points do no harm.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    tree = build(points, 1 if unique_distance else k, leaf_points, most_broadcast, scratch or Scratch(points.sparkSession, "nearest"))
    keep = tree.scratch.keep
    home = keep(_home(queries.where("lat is not null and long is not null").select("q_id", "lat", "long"), tree, k))
    own = _measured(home.where("leaf is not null").select("q_id", "qx", "qy", F.col("leaf").alias("node")), tree, k, unique_distance)
    bound = own.where(F.col("place") == k).select("q_id", F.col("distance").alias("own"))
    last = F.element_at("bars", -1)
    asked = keep(home.join(bound, "q_id", "left").select("q_id", "qx", "qy", F.when(F.size("bars") > 0, F.coalesce("own", last)).otherwise(F.col("own")).alias("reach"), F.when(F.col("own").isNull() & (F.size("bars") > 0), F.slice("bars", F.lit(1), F.size("bars") - 1)).otherwise(F.col("bars")).alias("bars")))
    done, step = None, 0
    if not unique_distance:
        return _measured(keep(_within(asked, tree, "front")), tree, k, unique_distance)
    while True:
        top = keep(_measured(keep(_within(asked, tree, f"front-{step}")), tree, k, unique_distance))
        # Points at equal distances can leave a unique search short; it then takes the next larger node.
        short = asked.where("reach is not null").join(top.where(F.col("place") == k).select("q_id"), "q_id", "left_anti")
        short = keep(short.select("q_id", "qx", "qy", F.when(F.size("bars") > 0, F.element_at("bars", -1)).alias("reach"), F.when(F.size("bars") > 0, F.slice("bars", F.lit(1), F.size("bars") - 1)).otherwise(F.col("bars")).alias("bars")))
        if short.isEmpty():
            return top if done is None else done.unionByName(top)
        enough = top.join(short.select("q_id"), "q_id", "left_anti")
        done = enough if done is None else done.unionByName(enough)
        asked, step = short, step + 1
