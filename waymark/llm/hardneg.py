"""Hard negatives by a multiway hyperplane tree (GNAT) over vectors of integers.

A node has up to ``arity`` split points, chosen far apart; a row belongs to the nearest one.  For every split
point and every child the node stores the range of distances from the point to all rows below that child.
Rows are lifted to one norm M by a further coordinate, so an inner product s with an anchor of norm a is
a distance with d^2 = a^2 + M^2 - 2 s, and a window of scores is an annulus around the anchor.  A child goes
if, for some split point, its range misses the distances that the annulus allows (d from the point lies between
max(p - outer, inner - p) and p + outer, p the point's distance from the anchor).  Leaves are exact: they are scanned by matrix products.

The split points are fitted on ``sample`` rows, those of the smallest hashes; every row is placed, and the
ranges come from all rows, so results equal brute force whatever the sample.  An anchor first scans its own
leaf, which bounds its k-th best score; then it visits only the leaves that the bound leaves over.  This is done once for
positives and once for the negatives' windows.

Rows and anchors meet by leaf, in a cogroup of at most about ``group_rows`` rows and ``group_anchors`` anchors: larger
leaves (many equal vectors) and more anchors are dealt to several by hash. The tree is broadcast; with
its ranges it has at most ``sample`` / 4 nodes of ``arity`` ** 2 pairs, whatever the number of rows. On vectors without any structure
nearly all leaves remain, and the work is that of all anchors against all rows, in blocks.

Defined results: rows with a null id, label or vector or a null or non-finite component take no part; rows equal
in id, label and vector count once, and rows that share only an id are different rows; equal scores go by smaller id;
shorter vectors end in zeros; scores are exact below 2 ** 53; an anchor without other rows of its label has no
positives, a positive without rows in its window no negatives; a negative positive score has no window; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm._store import Scratch

ARITY, LEAF_ROWS, SAMPLE = 16, 1024, 4096
GROUP_ROWS, GROUP_ANCHORS = 1024, 512
#: Distances are compared with this much room, times M: far more than rounding can move them.
SLACK = 1e-6

PACKED = "vec_id bigint, uid bigint, label int, norm double, v binary"
ASK = "a_id bigint, a_uid bigint, a_label int, a_norm double, a_v binary, own int, scores array<double>, least array<double>"
FOUND = "a_id bigint, a_uid bigint, slot int, vec_id bigint, uid bigint, score double"


def usable(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), sound))


def matrix(blobs: pa.Array, width: int) -> np.ndarray:
    """Rows of packed vectors, with zeros up to ``width``."""
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // 8
    flat = np.frombuffer(b"".join(blobs.to_pylist()), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy()


def _blobs(table, name: str) -> pa.Array:
    got = table.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def pack(rows: DataFrame) -> DataFrame:
    """vec_id, uid (hash of label and vector), label, norm (squared), v (doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(3)
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sums = np.concatenate([[0.0], np.cumsum(values * values)])
            norms = sums[ends] - sums[begins]
            raw = np.ascontiguousarray(values).tobytes()
            blobs = pa.array([raw[8 * a : 8 * e] for a, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(norms, pa.float64()), blobs], names=["vec_id", "uid", "label", "norm", "v"])

    v = F.col("v").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.xxhash64(F.col("label").cast("int"), v).alias("uid"), F.col("label").cast("int").alias("label"), v.alias("v"))
    return own.mapInArrow(run, PACKED)


@dataclass
class Node:
    points: np.ndarray  # (k, width): the split points
    lift: np.ndarray  # (k,): their further coordinate
    child: list[int]  # a node, or -1 - leaf
    low: np.ndarray = field(default=None)  # (point, child): least and greatest distance to the child's rows
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    width: int
    square: float  # M^2
    nodes: list[Node]
    n_leaves: int

    def lifted(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - norms, 0))

    def distances(self, node: Node, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ node.points.T + np.outer(lift, node.lift)), 0))

    def descend(self, x: np.ndarray, norms: np.ndarray, seen=None) -> np.ndarray:
        """Each row's leaf. ``seen`` gets every node's (number, distances, child) on the way."""
        out, lift = np.zeros(len(x), np.int32), self.lifted(norms)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            far = self.distances(node, x[rows], lift[rows])
            nearest = far.argmin(1)
            if seen:
                seen(number, far, nearest)
            for j, to in enumerate(node.child):
                own = rows[nearest == j]
                if to < 0:
                    out[own] = -1 - to
                elif len(own):
                    todo.append((to, own))
        return out

    def reachable(self, x: np.ndarray, norms: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        """For each leaf the anchors (rows of x) for which it may hold rows of an annulus; inner, outer: (anchor, window), nan for none."""
        out = [np.zeros(0, np.int64)] * self.n_leaves
        room = SLACK * max(1.0, self.square**0.5)
        todo = [(0, np.flatnonzero(~np.isnan(outer).all(1)))]
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            p = np.sqrt(np.maximum(norms[rows, None] + self.square - 2 * (x[rows] @ node.points.T), 0))
            alive = np.zeros((len(rows), len(node.child)), bool)
            for w in range(outer.shape[1]):
                r1, r2 = inner[rows, w, None], outer[rows, w, None]
                least, most = np.maximum(p - r2, r1 - p) - room, p + r2 + room
                alive |= ((node.high[None] >= least[:, :, None]) & (node.low[None] <= most[:, :, None])).all(1)
            for j, to in enumerate(node.child):
                own = rows[alive[:, j]]
                if to < 0:
                    out[-1 - to] = own
                elif len(own):
                    todo.append((to, own))
        return out


def fit(x: np.ndarray, square: float, leaf: int, arity: int = ARITY) -> Tree:
    """A tree whose leaves have at most ``leaf`` rows of the sample x, or equal ones."""
    rng = np.random.default_rng(0)
    tree = Tree(x.shape[1], square, [], 0)
    lift = tree.lifted((x * x).sum(1))
    full = np.hstack([x, lift[:, None]])

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            k = min(arity, max(2, -(-len(rows) // leaf)))
            pool = rng.permutation(rows)[: 3 * k]
            picked = [int(pool[0])]
            far = ((full[pool] - full[picked[0]]) ** 2).sum(1)
            while len(picked) < k and far.max() > 0:
                picked.append(int(pool[far.argmax()]))
                far = np.minimum(far, ((full[pool] - full[picked[-1]]) ** 2).sum(1))
            if len(picked) > 1:
                number = len(tree.nodes)
                node = Node(x[picked], lift[picked], [])
                tree.nodes.append(node)
                nearest = tree.distances(node, x[rows], lift[rows]).argmin(1)
                node.child = [grow(rows[nearest == j]) for j in range(len(picked))]
                return number
        tree.n_leaves += 1
        return -tree.n_leaves

    grow(np.arange(len(x)))
    return tree


def _placed(packed: DataFrame, tree: Tree, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.descend(matrix(b.column(4), sent.value.width), b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    return packed.mapInArrow(run, PACKED + ", leaf int")


def _measure(placed: DataFrame, tree: Tree, sent) -> None:
    """Fills the ranges of the tree's nodes from all rows; each task sends a row a pair that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def seen(number: int, far: np.ndarray, nearest: np.ndarray) -> None:
            k = far.shape[1]
            low, high = met.setdefault(number, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
            for j in np.unique(nearest):
                own = far[nearest == j]
                low[:, j], high[:, j] = np.minimum(low[:, j], own.min(0)), np.maximum(high[:, j], own.max(0))

        for b in batches:
            sent.value.descend(matrix(b.column(1), sent.value.width), b.column(0).to_numpy(zero_copy_only=False), seen)
        rows = [(number, i, int(j), low[i, j], high[i, j]) for number, (low, high) in met.items() for j in np.flatnonzero(np.isfinite(low[0])) for i in range(len(low))]
        names = ["node", "point", "child", "low", "high"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    got = placed.select("norm", "v").mapInArrow(run, "node int, point int, child int, low double, high double").groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for node in tree.nodes:  # a child without rows has an empty range
        node.low, node.high = np.full((len(node.child),) * 2, np.inf), np.full((len(node.child),) * 2, -np.inf)
    for r in got.collect():  # arity ** 2 rows a node at most
        tree.nodes[r["node"]].low[r["point"], r["child"]] = r["low"]
        tree.nodes[r["node"]].high[r["point"], r["child"]] = r["high"]


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of each anchor's k best fitting rows; at equal scores the first row."""
    value = np.where(fits, scores, -np.inf)
    if value.shape[1] > k:
        bar = -np.partition(-value, k - 1, axis=1)[:, k - 1]
        fits = fits & (value >= bar[:, None])
    a, r = np.nonzero(fits)
    order = np.lexsort((r, -scores[a, r], a))
    a, r = a[order], r[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], r[place < k]


def _scan(asks: DataFrame, placed: DataFrame, width: int, same: bool, k: int, window: tuple[int, int], group_rows: int, group_anchors: int) -> DataFrame:
    """The k best rows of each anchor and window in the leaf of each ask: of its label (one window, no upper end), or of others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out: list[list[np.ndarray]] = [[none] for _ in range(6)]
        if len(left) and len(right):
            ids, uids, labels = (_column(left, c) for c in ("vec_id", "uid", "label"))
            order = np.lexsort((uids, ids))
            ids, uids, labels = ids[order], uids[order], labels[order]
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (uids[1:] != uids[:-1])
            ids, uids, labels = ids[first], uids[first], labels[first]
            x = matrix(_blobs(left, "v"), width)[order][first]
            a_ids, a_uids, a_labels = (_column(right, c) for c in ("a_id", "a_uid", "a_label"))
            vectors = matrix(_blobs(right, "a_v"), width)
            scores_of, least_of = right.column("scores").to_pylist(), right.column("least").to_pylist()
            some = max(1, (1 << 21) // len(ids))
            for at in range(0, len(a_ids), some):
                part = slice(at, at + some)
                s = vectors[part] @ x.T
                alike = a_labels[part, None] == labels[None, :]
                slots = max(map(len, least_of[part]))
                for slot in range(slots):
                    least = np.array([v[slot] if slot < len(v) else np.inf for v in least_of[part]])
                    fits = s >= least[:, None]
                    if same:
                        fits &= alike & ~((ids[None, :] == a_ids[part, None]) & (uids[None, :] == a_uids[part, None]))
                    else:
                        good = np.array([v[slot] if slot < len(v) else -1.0 for v in scores_of[part]])[:, None]
                        fits &= ~alike & (window[0] * good <= 100 * s) & (100 * s <= window[1] * good)
                    a, r = _best(s, fits, k)
                    for col, values in zip(out, (a_ids[part][a], a_uids[part][a], np.full(len(a), slot), ids[r], uids[r], s[a, r]), strict=True):
                        col.append(values)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(np.concatenate(c), kind) for c, kind in zip(out, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    # Two numbers a leaf.
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("r_parts")).join(asks.groupBy("leaf").agg(F.ceil(F.count("*") / group_anchors).cast("int").alias("a_parts")), "leaf")
    parts = F.broadcast(parts)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("r_parts")).cast("int").alias("r_part"), each("a_parts").alias("a_part"), "vec_id", "uid", "label", "v")
    mine = asks.join(parts, "leaf").select("leaf", each("r_parts").alias("r_part"), F.pmod(F.xxhash64("a_id"), F.col("a_parts")).cast("int").alias("a_part"), "a_id", "a_uid", "a_label", "a_v", "scores", "least")
    keys = ["leaf", "r_part", "a_part"]
    return rows.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(run, FOUND)


def _routed(asks: DataFrame, sent, same: bool, window: tuple[int, int]) -> DataFrame:
    """Each ask with every leaf, but its own, that the tree leaves over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows if tree.nodes else 0, 256):
                b = whole.slice(at, 256)
                x, norms = matrix(_blobs(b, "a_v"), tree.width), _column(b, "a_norm")
                least, scores = b.column(b.schema.get_field_index("least")).to_pylist(), b.column(b.schema.get_field_index("scores")).to_pylist()
                slots = max(1, *map(len, least)) if least else 1
                low, high = np.full((len(x), slots), np.nan), np.full((len(x), slots), np.inf)
                for i, (mine, good) in enumerate(zip(least, scores, strict=True)):
                    for j, value in enumerate(mine):
                        if same:
                            low[i, j] = value
                        elif good[j] >= 0:
                            low[i, j], high[i, j] = max(value, window[0] * good[j] / 100), window[1] * good[j] / 100
                base = (norms + tree.square)[:, None]
                outer = np.where(np.isneginf(low), np.inf, np.sqrt(np.maximum(base - 2 * np.where(np.isneginf(low), 0, low), 0)))
                inner = np.where(np.isposinf(high), 0, np.sqrt(np.maximum(base - 2 * np.where(np.isposinf(high), 0, high), 0)))
                own = _column(b, "own")
                for leaf, rows in enumerate(tree.reachable(x, norms, inner, outer)):
                    rows = rows[own[rows] != leaf]
                    if len(rows):
                        got = b.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.full(len(rows), leaf), pa.int32())], names=[*got.schema.names, "leaf"])

    return asks.mapInArrow(run, ASK + ", leaf int")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("a_id", "a_uid", "slot").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _bounded(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The asks with the k-th score of each window so far as the least that counts."""
    bars = found.where(F.col("place") == k).groupBy("a_id", "a_uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("bars"))  # a window each
    rest = asks.join(bars, ["a_id", "a_uid"], "left")
    least = F.transform("least", lambda old, i: F.greatest(old, F.coalesce(F.try_element_at("bars", i), old)))
    return rest.withColumn("least", least).drop("bars")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, arity: int = ARITY, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, group_rows: int = GROUP_ROWS, group_anchors: int = GROUP_ANCHORS, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (array of whole numbers); anchor: a condition on vec_id.  Positives are an anchor's best
    rows of its label; negatives of a positive the best rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "hardneg")
    window = low, high
    packed = scratch.table(pack(usable(rows)), "packed")
    stats = packed.agg(F.count("*").alias("n"), F.max("norm").alias("square"), F.max(F.octet_length("v")).alias("bytes")).first()
    some = packed.orderBy(F.xxhash64("vec_id", "uid"), "vec_id", "uid").limit(sample).select("v").toArrow()
    width = (stats["bytes"] or 0) // 8
    tree = fit(matrix(_blobs(some, "v"), width), stats["square"] or 0.0, max(4, -(-len(some) * leaf_rows // max(stats["n"], 1))), arity)
    sent = spark.sparkContext.broadcast(tree)
    placed = scratch.table(_placed(packed, tree, sent), "placed")
    _measure(placed, tree, sent)
    sent.unpersist()
    sent = spark.sparkContext.broadcast(tree)

    unbounded = F.array(F.lit(float("-inf")))
    asks = placed.where(anchor).dropDuplicates(["vec_id", "uid"]).select(F.col("vec_id").alias("a_id"), F.col("uid").alias("a_uid"), F.col("label").alias("a_label"), F.col("norm").alias("a_norm"), F.col("v").alias("a_v"), F.col("leaf").alias("own"), F.array().cast("array<double>").alias("scores"), unbounded.alias("least"))
    asks = scratch.table(asks, "asks")

    def search(asks: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        near = scratch.table(_top(_scan(asks.withColumn("leaf", F.col("own")), placed, width, same, k, window, group_rows, group_anchors), k), f"{name}-own")
        others = scratch.table(_routed(_bounded(asks, near, k), sent, same, window), f"{name}-asks")
        far = scratch.table(_scan(others, placed, width, same, k, window, group_rows, group_anchors), f"{name}-others")
        return _top(near.drop("place").unionByName(far), k)

    good = scratch.table(search(asks, True, positives, "positives"), "positives")
    listed = good.groupBy("a_id", "a_uid").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # ``positives`` each
    windows = asks.drop("scores", "least").join(listed, ["a_id", "a_uid"]).withColumn("scores", F.col("p.score")).withColumn("least", F.transform("p", lambda x: F.lit(float("-inf")))).drop("p")
    names = [f.split()[0] for f in ASK.split(", ")]
    bad = search(scratch.table(windows.select(*names), "windows"), False, negatives, "negatives")
    pos = good.select("a_id", "a_uid", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").cast("bigint").alias("positive_score"))
    out = bad.join(pos, ["a_id", "a_uid", "slot"])
    return out.select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").cast("bigint").alias("negative_score"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS vec_id, a.label = e.label AS alike, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
