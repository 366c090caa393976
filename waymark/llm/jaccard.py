"""N-gram Jaccard join and its connected components, exact.

Two documents link when their sets of ``size``-word shingles have a Jaccard
similarity of ``num`` / ``den`` or more.  All shingles are ordered by document
frequency, rarest first.  If two sets link, their prefixes, the first
n - ceil(t * n) + 1 shingles of each, share one.

1. Each block of texts sends its (shingle, text) entries, as compressed sorted
   keys, to the bucket of the shingle, and each text's set digest to the bucket of
   the digest.  Buckets are ranges of a hash, so none is hot, and their
   number follows the corpus' bytes, so none outgrows a task.
2. A bucket counts document frequencies and answers only for shingles of two
   or more documents; a digest bucket names the smallest doc_id of each class of equal sets.
3. A block's answers give each text its prefix.  A text whose prefix has only
   shingles of its own links with nothing and goes no further; nor does any but
   one text of a class.
4. Prefix shingles meet in a join with length and positional filters; each pair is
   verified once, by a suffix filter (counts in key ranges bound the overlap) and
   the exact intersection of the shared shingles.

A group of thousands of near copies does not meet in all pairs.  First each
posting list joins its members only to a hub, the one with the fewest shingles of its
own, and the verified links make components.  Then members of one list that
are in different components meet, so no link between components is lost; links
within one component cannot change it.  Members that share half with the hub meet by what
they differ in from it (``near_hub_links``); for the others the overlaps with the hub bound
their own: if shingle t is the first that x and y share, what they share lies at t or
after it, and either in the hub, at most the smaller of their overlaps with it, or
outside, at most the smaller of what each has outside the hub at t or after it.

Defined results: null and empty texts have no shingles, an n_shingles of 0, and their
own doc_id as component; a text of fewer words than ``size`` has its whole sequence
as one shingle; rows that repeat a doc_id are judged by their own text and their
links count for that doc_id; a null doc_id links with nothing and has a null
component; a similarity equal to the threshold links; of equally rare shingles the smaller hash is the rarer
one, which changes no result; texts of any length are taken whole, a block's memory growing with its longest; an empty
table gives no rows; other columns are ignored, or passed through by ``keep_first``.

Shingles are compared by 48 to 63 bits of a 64-bit hash, more for larger corpora (``key_bits``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm import _text
from waymark.llm._store import Scratch, join_salted, join_split

#: Ids of spare documents that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
BINS = 32
NO_ID = np.iinfo(np.int64).min
SENT = "kind int, bucket int, chunk string, a binary, b binary, c binary, d binary"
ANSWERS = "kind int, chunk string, a binary, b binary, c binary, d binary"
DOCS = "doc_id bigint, n bigint, rep bigint, own int, shared int, bins binary, prefix array<bigint>, keys binary"
_KIND = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KIND[x.split()[1]]) for x in ddl.split(", ")])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _arrow_schema(ddl)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def key_bits(n_bytes: int) -> int:
    """Bits of a shingle's key: 14 beyond what counts the corpus' bytes, so that few shingles share a key at any size."""
    return min(63, max(48, n_bytes.bit_length() + 14))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, text index) of the distinct shingles of each text."""
    data, offsets = _text.text_bytes(column)
    words = _text.Words(data, offsets)
    hashes = words.hashes(True)
    grams, at = _text.windows(hashes, words.first, size)
    owner = words.owner()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([_text.sequence_hash(hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((owner, grams)) if len(short) else np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def _send(docs: DataFrame, size: int, bits: int, n_buckets: int, block_bytes: int) -> DataFrame:
    schema = _arrow_schema(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        edges = (np.arange(n_buckets + 1, dtype=object) * (1 << bits) // n_buckets).astype(np.uint64)
        for batch in batches:
            for a, b in _text.blocks(batch.column(1), block_bytes):
                ids = batch.column(0).slice(a, b - a).fill_null(NO_ID).to_numpy()
                grams, owner = shingle_sets(batch.column(1).slice(a, b - a), size)
                chunk = f"{part}-{serial}"
                serial += 1
                n = np.bincount(owner, minlength=b - a)
                digests = np.zeros((2, b - a), np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(digests[0], owner, _text.mix(grams))
                    np.add.at(digests[1], owner, _text.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))
                rows = []
                keys = grams >> np.uint64(64 - bits)
                cuts = np.searchsorted(keys, edges)
                cuts[-1] = len(keys)
                for k in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[k], cuts[k + 1])
                    rows.append((0, int(k), chunk, _text.pack_sorted(keys[own]), _text.pack(owner[own].astype(np.uint32)), None, None))
                place = (digests[0] % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                    rows.append((1, int(place[own[0]]), chunk, _text.pack(own.astype(np.uint32)), _text.pack(n[own].astype(np.int64)), _text.pack(ids[own]), np.ascontiguousarray(digests[:, own]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.mapInArrow(run, SENT)


def _count(rows: list[dict]) -> list[tuple]:
    """Answers of a shingle bucket: for each block, its entries of shingles that two or more documents have."""
    keys = [_text.unpack_sorted(r["a"]) for r in rows]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(first, len(ordered)))
    frequency = np.empty(len(keys), np.uint32)
    frequency[order] = np.repeat(times, times)
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        own = at + np.flatnonzero(frequency[at : at + n] > 1)
        if len(own):
            out.append((0, r["chunk"], _text.pack_sorted(keys[own]), _text.pack(_text.unpack(r["b"], np.uint32)[own - at]), _text.pack(frequency[own]), None))
        at += n
    return out


def _classes(rows: list[dict]) -> list[tuple]:
    """Answers of a digest bucket: each text's size, doc_id and the smallest doc_id with an equal set."""
    ids = [_text.unpack(r["c"], np.int64) for r in rows]
    sizes = [len(x) for x in ids]
    n = np.concatenate([_text.unpack(r["b"], np.int64) for r in rows])
    digests = np.concatenate([np.frombuffer(r["d"], np.uint64).reshape(2, -1) for r in rows], axis=1)
    ids = np.concatenate(ids)
    order = np.lexsort((ids, n, digests[1], digests[0]))
    alone = (n == 0) | (ids == NO_ID)
    o = order
    new = np.ones(len(o), bool)
    new[1:] = (digests[0][o[1:]] != digests[0][o[:-1]]) | (digests[1][o[1:]] != digests[1][o[:-1]]) | (n[o[1:]] != n[o[:-1]]) | alone[o[1:]] | alone[o[:-1]]
    group = np.cumsum(new) - 1
    rep = np.empty(len(o), np.int64)
    rep[o] = ids[o[np.flatnonzero(new)]][group]
    is_rep = np.zeros(len(o), np.int8)
    is_rep[o] = new
    out, at = [], 0
    for r, size in zip(rows, sizes, strict=True):
        own = slice(at, at + size)
        out.append((1, r["chunk"], r["a"], r["b"], r["c"], rep[own].tobytes() + is_rep[own].tobytes()))
        at += size
    return out


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    return _table(_count(rows) if rows[0]["kind"] == 0 else _classes(rows), ANSWERS)


def _gather(num: int, den: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        classes = [r for r in rows if r["kind"] == 1]
        at = np.concatenate([_text.unpack(r["a"], np.uint32) for r in classes]).astype(np.int64)
        order = np.argsort(at)
        n = np.concatenate([_text.unpack(r["b"], np.int64) for r in classes])[order]
        ids = np.concatenate([_text.unpack(r["c"], np.int64) for r in classes])[order]
        rep = np.concatenate([np.frombuffer(r["d"][: len(r["d"]) // 9 * 8], np.int64) for r in classes])[order]
        is_rep = np.concatenate([np.frombuffer(r["d"][len(r["d"]) // 9 * 8 :], np.int8) for r in classes])[order] > 0
        shared = [r for r in rows if r["kind"] == 0]
        none = [np.zeros(0, np.int64)]
        owner = np.concatenate([_text.unpack(r["b"], np.uint32) for r in shared] or none).astype(np.int64)
        keys = np.concatenate([_text.unpack_sorted(r["a"]) for r in shared] or none).astype(np.int64)
        times = np.concatenate([_text.unpack(r["c"], np.uint32) for r in shared] or none).astype(np.int64)
        n_shared = np.bincount(owner, minlength=len(n))
        own = n - n_shared
        prefix = n + (-num * n // den) + 1  # n - ceil(t * n) + 1
        going = is_rep & (own < prefix) & (n > 0) & (ids != NO_ID)
        take = going[owner]
        owner, keys, times = owner[take], keys[take], times[take]
        by_rarity = np.lexsort((keys, times, owner))
        by_key = np.lexsort((keys, owner))
        ends = np.cumsum(np.bincount(owner, minlength=len(n)))
        out = []
        for i in range(len(n)):
            id_ = None if ids[i] == NO_ID else int(ids[i])
            rest = (None,) * 5
            if going[i]:
                mine = slice(ends[i] - n_shared[i], ends[i])
                sorted_keys = keys[by_key[mine]].astype(np.uint64)
                bins = np.bincount((sorted_keys >> np.uint64(bits - 5)).astype(np.int64), minlength=BINS).astype(np.uint32)
                rest = (int(own[i]), int(n_shared[i]), bins.tobytes(), keys[by_rarity[mine]][: prefix[i] - own[i]].tolist(), _text.pack_sorted(sorted_keys))
            out.append((id_, int(n[i]), id_ if id_ is None else int(rep[i]), *rest))
        return _table(out, DOCS)

    return run


def _verify(num: int, den: int, hub: bool):
    """a, b of each pair that links. hub: of every pair, with both (shared shingles), links, and what b lacks of the hub a and has beside it, if they share half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            got: list[tuple] = []
            c = {k: v.to_pylist() for k, v in _text.columns(batch).items()}
            for a, b, na, nb, bins_a, bins_b, keys_a, keys_b in zip(*(c[k] for k in ("a", "b", "na", "nb", "bins_a", "bins_b", "keys_a", "keys_b")), strict=True):
                links = lambda both: den * both >= num * (na + nb - both)  # noqa: B023, E731
                if not hub and not links(int(np.minimum(np.frombuffer(bins_a, np.uint32), np.frombuffer(bins_b, np.uint32)).sum())):
                    continue
                if last != (a, na, keys_a):
                    last, known = (a, na, keys_a), _text.unpack_sorted(keys_a)
                other = _text.unpack_sorted(keys_b)
                at = np.searchsorted(known, other)
                at[at == len(known)] = 0
                same = known[at] == other if len(known) else np.zeros(len(other), bool)
                both = int(same.sum())
                if hub:
                    lost = added = None
                    if 2 * both >= max(len(known), len(other)):
                        lost, added = np.delete(known, at[same]).astype(np.int64), other[~same].astype(np.int64)
                    got.append((a, b, both, links(both), lost, added))
                elif links(both):
                    got.append((a, b))
            kinds = HUB if hub else HUB[:2]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])

    return run


HUB = [("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("links", pa.bool_()), ("lost", pa.list_(pa.int64())), ("added", pa.list_(pa.int64()))]


def near_hub_links(near: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """a, b of members of one hub that link across labels, exactly, by what they differ in from it.

    near: hub, size (the hub's shared shingles), id, label, n, own, lost, added.  What x and y share is
    size - lost_x - lost_y + their common differences, so to link they need r of those in common.  r is
    1 or more where one of them does not link with the hub, and the least the group allows
    is known for each member, so common differences are found by a rare-first prefix.
    """
    each = near.withColumn("n_lost", F.size("lost")).withColumn("diff", F.concat("lost", "added"))
    slack = F.min(num * (F.col("own") + F.size("added")) + den * F.col("n_lost")).alias("slack")
    groups = each.groupBy("hub").agg(slack, F.count("*").alias("many"), F.count_distinct("label").alias("labels")).where("labels > 1").drop("labels")
    each = join_split(each, scratch.table(groups, "hub-groups"), ["hub"], near.count())
    need = F.ceil((num * (F.col("n") + F.col("size")) + F.col("slack") - (num + den) * (F.col("size") - F.col("n_lost"))) / F.lit(num + den))
    each = scratch.table(each.withColumn("need", F.greatest(F.lit(1), need)).where(F.size("diff") >= F.col("need")).drop("many", "slack"), "hub-members")
    rows = each.select("hub", "id", "label", "need", F.size("diff").alias("n_diff"), F.explode("diff").alias("key"))
    found = scratch.table(rows.groupBy("hub", "key").agg(F.count("*").alias("many")), "hub-keys")
    total = rows.count()
    ranked = join_split(rows, found, ["hub", "key"], total)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("hub", "id").orderBy("many", "key")))
    prefix = scratch.table(ranked.where((F.col("place") <= F.col("n_diff") - F.col("need") + 1) & (F.col("many") > 1)), "hub-prefixes")
    member = F.struct("id", "label", "need", F.col("n_diff").alias("n"), "place")
    met = join_salted(prefix.select("hub", "key", member.alias("x")), prefix.select("hub", "key", "many", member.alias("y")), ["hub", "key"], F.xxhash64("x.id"), total)
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    met = met.where((F.col("x.label") < F.col("y.label")) & (left >= F.greatest("x.need", "y.need"))).select("hub", F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda k: each.select("hub", F.col("id").alias(k), F.struct("n", "n_lost", "diff", "size").alias(f"of_{k}"))
    both = met.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    shared = F.col("of_a.size") - F.col("of_a.n_lost") - F.col("of_b.n_lost") + F.size(F.array_intersect("of_a.diff", "of_b.diff"))
    return both.where(shared * (num + den) >= num * (F.col("of_a.n") + F.col("of_b.n"))).select("a", "b")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, label: the smallest id that edges (a, b) reach, for every id on an edge.

    Each round takes the smallest label among the neighbours and then the label's
    own label, so chains halve; every round is a written table.
    """
    both = scratch.table(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    i = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # The label of a label: its own row, looked up by id.
        parent = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = scratch.table(stepped.join(parent, "label", "left").select("id", "was", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-{i + 1}")
        done = new.where("label <> was").limit(1).count() == 0
        scratch.remove(f"{name}-{i}")
        labels, i = new.select("id", "label"), i + 1
        if done:
            return labels


def link_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_buckets = _text.bucket_count(n_bytes)
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = scratch.table(rows, "texts")  # blocks are named by place, so a lost task must find the same rows there
    bits = key_bits(n_bytes)
    answers = _send(rows, size, bits, n_buckets, _text.block_bytes(n_bytes)).groupBy("kind", "bucket").applyInArrow(_answer, ANSWERS)
    members = scratch.table(answers.groupBy("chunk").applyInArrow(_gather(num, den, bits), DOCS), "members")

    nodes = members.where("keys is not null")
    tokens = scratch.table(nodes.select(F.col("doc_id").alias("id"), "n", "own", "shared", F.posexplode("prefix").alias("at", "token")).withColumn("at", F.col("at") + F.col("own")), "tokens")
    lists = scratch.table(tokens.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("own", "id", "n", "shared", "at")).alias("hub")).where("many > 1"), "lists")
    total = tokens.count()

    def may_link(x: str, y: str):
        """Length filter, shared-size filter and positional filter, as integers: overlap * (num + den) >= num * (n + n)."""
        c = lambda side, name: F.col(f"{side}.{name}")
        need = num * (c(x, "n") + c(y, "n"))
        short = (den * c(x, "n") >= num * c(y, "n")) & (den * c(y, "n") >= num * c(x, "n"))
        most = F.least(c(x, "shared"), c(y, "shared"))
        # At the first shingle that both share, all that they share lies at it or after it.
        left = F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at"))
        return short & (F.least(most, left) * (num + den) >= need)

    def side(k: str) -> DataFrame:
        return nodes.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("bins").alias(f"bins_{k}"), F.col("keys").alias(f"keys_{k}"))

    def verified(pairs: DataFrame, name: str, hub: bool) -> DataFrame:
        ready = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bins_a", "bins_b", "keys_a", "keys_b")
        return scratch.table(ready.mapInArrow(_verify(num, den, hub), "a bigint, b bigint" + (", both bigint, links boolean, lost array<bigint>, added array<bigint>" if hub else "")), name)

    in_lists = join_split(tokens, lists, ["token"], total)
    to_hub = in_lists.select(F.col("hub").alias("x"), F.struct("id", "n", "shared", "at").alias("y")).where("x.id <> y.id").where(may_link("x", "y"))
    compared = verified(to_hub.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "hub-overlaps", True)
    edges = compared.where("links").select("a", "b")
    labels = components(edges, scratch, "hub")

    placed = in_lists.select("token", "id", "n", "shared", "at", F.col("hub.id").alias("hub")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = scratch.table(placed, "in-lists")
    mixed = scratch.table(placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).where("low < high").select("token", "many"), "mixed")
    # Of what x shares with the hub, what lies at a common prefix shingle or after it.
    common = compared.select("a", "b", "both").join(tokens.select(F.col("id").alias("b"), "token", "at"), "b").join(tokens.select(F.col("id").alias("a"), "token"), ["a", "token"])
    before = F.row_number().over(Window.partitionBy("a", "b").orderBy("at", "token")) - 1
    known = common.select(F.col("a").alias("hub"), F.col("b").alias("id"), "token", (F.col("both") - before).alias("in_hub"))
    placed = join_split(placed, mixed, ["token"], total).where("id <> hub").join(known, ["hub", "id", "token"], "left")
    close = compared.where("lost is not null").select(F.col("a").alias("hub"), F.col("b").alias("id"), "lost", "added")
    placed = placed.join(close.select("hub", "id", F.lit(True).alias("near")), ["hub", "id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    placed = scratch.table(placed.withColumn("outside", F.col("n") - F.col("at") - F.col("in_hub")).select("token", "many", "id", "n", "shared", "at", "label", "near", "in_hub", "outside"), "placed")
    bound = F.least("x.in_hub", "y.in_hub") + F.least("x.outside", "y.outside")
    by_hub = bound.isNull() | (bound * (num + den) >= num * (F.col("x.n") + F.col("y.n")))  # least() skips nulls; one side alone is a bound too
    member = F.struct("id", "n", "shared", "at", "label", "near", "in_hub", "outside")
    # One of a pair at least is far from the hub; two that are near meet by their differences below.
    across = join_salted(placed.where("not near").select("token", member.alias("x")), placed.select("token", "many", member.alias("y")), ["token"], F.xxhash64("x.id"), total)
    once = F.when(F.col("y.near"), F.col("x.label") != F.col("y.label")).otherwise(F.col("x.label") < F.col("y.label"))
    across = across.where(once & may_link("x", "y") & by_hub)
    more = verified(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "cross-links", False)
    of = nodes.select(F.col("doc_id").alias("id"), "n", "own").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    near = scratch.table(close.join(nodes.select(F.col("doc_id").alias("hub"), F.col("shared").alias("size")), "hub").join(of, "id"), "near")
    more = more.unionByName(near_hub_links(near, num, den, scratch))
    labels = components(edges.union(more), scratch, "all")
    out = members.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(labels, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """The documents, all columns as they are, without those that reach a smaller doc_id by links.

    Rows of the same doc_id stay or go together; rows of a null doc_id stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    spare = scratch.table(link_components(docs, size, num, den, scratch).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "spare")
    spare = F.broadcast(spare) if spare.count() <= MOST_BROADCAST else spare
    return docs.join(spare, docs["doc_id"].cast("bigint") == spare["_id"], "left_anti")


def sql(size: int, num: int, den: int) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {size - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.low, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)
"""
