"""Postings in blocks, read in ascending order until a search has its results.

A block has the ascending ids of one list (mult, token, exact) within one span of SPAN string
numbers.  Lists of several tokens meet span by span, so a search that stops early has read only the first spans of its lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import text
from waymark.plans.store import Scratch

SPAN = 4096
#: Spans of a phrase's rarest list that its first round reads; each further round reads twice as many.
FIRST_SPANS = 2
SALTS = 32
#: Rows that look blocks up, up to which they are broadcast; more are shuffled.
MOST_BROADCAST = 100_000


def _asking(rows: DataFrame) -> DataFrame:
    """The side of a join that looks blocks up: the blocks, which pack into files of a small size, are never broadcast."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows.hint("merge")


def blocked(posting: DataFrame, span: int = SPAN) -> DataFrame:
    """mult, token, span, exact, n, low, high, ids: the blocks of postings (mult, token, idx, exact)."""
    keys = ["mult", "token", "span", "exact"]
    rows = posting.select("mult", "token", F.floor(F.col("idx") / span).cast("bigint").alias("span"), "exact", "idx")
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("idx")).alias("ids"))  # ``span`` ids at most
    return out.select(*keys, F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("low"), F.element_at("ids", -1).alias("high"), "ids")


def _tokens(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """q_id, v, n, token, mult, whole, n_exact, n_approx of phrases all of whose tokens are known."""
    t = phrases.select("q_id", "v", F.explode(text.search_tokens(F.col("words"))).alias("t"), "exact_words", F.size(F.array_distinct("words")).alias("n"))
    t = t.select("q_id", "v", "n", "t.token", "t.mult", F.array_contains("exact_words", F.col("t.token")).alias("whole"))
    known = t.join(vocab, ["token", "mult"]).withColumn("_known", F.count("*").over(Window.partitionBy("q_id", "v")))
    return known.where("_known = n").drop("_known")


def _drivers(tokens: DataFrame, blocks: DataFrame, first_level: bool) -> DataFrame:
    """q_id, v, spans: those of each phrase's rarest list, ascending; in the first level a token with exact postings has only those."""
    only = (F.col("whole") | ((F.col("n_exact") > 0) & F.lit(first_level))) if first_level else F.col("whole")
    size = F.col("n_exact") + F.when(only, 0).otherwise(F.col("n_approx"))
    place = F.row_number().over(Window.partitionBy("q_id", "v").orderBy(size, "token"))
    rarest = tokens.withColumn("only", only).withColumn("_place", place).where("_place = 1").select("q_id", "v", "token", "mult", "only")
    heads = blocks.select("mult", "token", "span", "exact")
    return _asking(rarest).join(heads, ["mult", "token"]).where("exact or not only").groupBy("q_id", "v").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def intersect(phrases: DataFrame, blocks: DataFrame, vocab: DataFrame, scratch: Scratch, limit: int = 1024, allowed: DataFrame | None = None, first_spans: int = FIRST_SPANS, trace: list[DataFrame] | None = None) -> DataFrame:
    """q_id, v, idx, level, pos: as search.intersect, from blocks; ``allowed`` has idx.

    First the results of level 0 are looked for, in which a token with exact postings counts only by those: spans ascend, so a
    phrase with ``limit`` of them is done.  The others then read all their lists, again by ascending spans, until their
    results of levels 0 and 1 are enough.  A round is a join on (mult, token, span) for all phrases at once, and its blocks are added to ``trace``.
    """
    key = ["q_id", "v"]
    tokens = scratch.keep(_tokens(phrases, vocab))
    found: DataFrame | None = None
    enough = None  # phrases that need no second stage, with their results so far
    for first_level in (True, False):
        stage = tokens if first_level else tokens.join(enough.where(~F.col("done")).select(*key), key, "left_semi")
        front = scratch.keep(_drivers(stage, blocks, first_level).withColumn("got", F.lit(0).cast("bigint")))
        if not first_level:
            front = scratch.keep(front.drop("got").join(enough.select(*key, "got"), key))
        at, width, all_counts = 0, first_spans, None
        while True:
            going = front.where((F.col("got") < limit) & (F.size("spans") > at))
            if going.isEmpty():
                break
            spans = going.select(*key, F.explode(F.slice("spans", at + 1, width)).alias("span"))
            met = _asking(spans.join(stage, key)).join(blocks.select("mult", "token", "span", "exact", "ids"), ["mult", "token", "span"])
            if first_level:
                met = met.where(F.col("exact") | ((F.col("n_exact") == 0) & ~F.col("whole")))
            else:
                met = met.where(F.col("exact") | ~F.col("whole"))
            met = scratch.keep(met.select(*key, "n", "span", "token", "exact", "n_exact", "ids"))
            if trace is not None:
                trace.append(met)
            if first_level:
                lists = met.groupBy(*key, "n", "span", "token").agg(F.flatten(F.collect_list("ids")).alias("ids")).groupBy(*key, "n", "span").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("n"))
                shared = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
                hits = lists.select(*key, F.explode(shared).alias("idx"), F.lit(0).cast("bigint").alias("level"))
            else:
                one = met.select(*key, "n", "token", F.explode("ids").alias("idx"), F.when(F.col("exact") | (F.col("n_exact") == 0), 0).otherwise(1).alias("level"))
                one = one.groupBy(*key, "n", "token", "idx").agg(F.min("level").alias("level"))
                hits = one.groupBy(*key, "n", "idx").agg(F.count("*").alias("_found"), F.sum("level").alias("level")).where("_found = n and level > 0").select(*key, "idx", "level")
            if allowed is not None:
                hits = hits.join(allowed.select("idx"), "idx", "left_semi").select(*key, "idx", "level")
            hits = scratch.keep(hits)
            found = hits if found is None else found.unionByName(hits)
            counts = hits.where("level <= 1").groupBy(*key).agg(F.count("*").alias("more"))
            front = scratch.keep(front.join(counts, key, "left").withColumn("got", F.col("got") + F.coalesce("more", F.lit(0))).drop("more"))
            at, width = at + width, 2 * width
        enough = front.select(*key, "got", (F.col("got") >= limit).alias("done"))
        if first_level:  # a phrase whose rarest exact list is empty has no row yet
            enough = scratch.keep(tokens.select(*key).distinct().join(enough, key, "left").select(*key, F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("done", F.lit(False)).alias("done")))
    if found is None:
        found = tokens.select(*key, F.lit(0).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("level")).limit(0)
    order = lambda *by: F.row_number().over(Window.partitionBy(*key, *by).orderBy("level", "idx"))
    part = found.withColumn("_salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS))).withColumn("_k", order("_salt")).where(F.col("_k") <= limit)
    return part.withColumn("_k", order()).where(F.col("_k") <= limit).select(*key, "idx", "level", (F.col("_k") - 1).alias("pos"))
