"""Benchmark decontamination: a prefix-filtered set join, DataFrame operations only.

An item's windows are its runs of ``window`` words (a shorter item is one
window).  A window's shingles are ordered by how rare they are in the corpus;
since a window must be contained whole, its prefix is its one rarest shingle.
Document positions whose shingle is some window's prefix are candidates; those
whose window would begin before the text or end after it fall away, and the rest
is compared word by word with the item-sized window, in the task that found it.

Up to ``most_broadcast`` windows are broadcast.  With more, a broadcast filter of their shingles, of bounded
size, first leaves of the positions those that may have one, where they are read; these
meet the windows by a salted shuffle, and the candidates their texts by another. Either way the corpus is read
twice, whatever the number of windows. Occurrences carry a window's id; item ids are joined last, salted for
windows that very many documents have.

Defined results: null and empty texts have no words and no hits; an item without
words or without item_id is left out; repeated items count once; rows of equal
doc_id and equal text are one document, rows of equal doc_id and other text give
a row each; of a window's equally rare shingles the smaller hash and then the first is its prefix, which changes no
result; texts of any length are searched whole; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm._store import Scratch, join_salted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() does that alone where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    inner = F.btrim(lower_ascii(text), F.lit(BREAKS))
    return F.when(inner != "", F.split(inner, BREAK)).otherwise(F.array().cast("array<string>"))


def _shingle(w: Column, at: Column, size: int) -> Column:
    """Hash of words at..at+size-1 (from 0); null past the end."""
    whole = F.xxhash64(F.lit(size), *[F.get(w, at + j) for j in range(size)])
    return F.when(at + size <= F.size(w), whole)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, words: the distinct windows of each item."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    each = w.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    return each.select("item_id", F.slice("w", F.col("at") + 1, F.col("n")).alias("words")).distinct()


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """The windows with size (of their shingles) and tokens: array of (at, hash)."""

    def all_of(s: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("words") - s), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(s), *[F.get(F.col("words"), i + j) for j in range(s)]).alias("hash")))

    by_size = [all_of(s) for s in range(1, shingle + 1)]
    tokens = reduce(lambda rest, s: F.when(F.col("size") == s, by_size[s - 1]).otherwise(rest), range(1, shingle), by_size[shingle - 1])
    return windows.withColumn("size", F.least(F.size("words"), F.lit(shingle))).withColumn("tokens", tokens)


def _positions(docs: DataFrame, sizes: list[int], outer: bool) -> DataFrame:
    """A row for each word position and shingle size, with its hash."""
    spread = (F.posexplode_outer if outer else F.posexplode)("w")
    rows = docs.select("*", spread.alias("at", "word"))
    if len(sizes) == 1:
        return rows.withColumn("hash", _shingle(F.col("w"), F.col("at"), sizes[0])).drop("word")
    return rows.withColumn("hash", F.explode(F.array(*[_shingle(F.col("w"), F.col("at"), s) for s in sizes]))).drop("word")


def _bits(hash_: Column) -> Column:
    """Two bits of a 64-bit word, from the low bits of a hash."""
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(hash_, by).bitwiseAND(F.lit(63)).cast("int"))
    return one(0).bitwiseOR(one(6))


def shingle_filter(tokens: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(slot, word; how many high bits of a hash are its slot): two bits in one word for each token (hash), about four tokens a word.

    A filter has 2^20 words at most, so it is broadcast; with more tokens than it holds well it lets more through, and loses none.
    """
    high = max(6, min(20, (n // 4).bit_length()))
    return tokens.groupBy(F.shiftrightunsigned("hash", 64 - high).alias("slot")).agg(F.bit_or(_bits(F.col("hash"))).alias("word")), high


def _matched(docs: DataFrame, sizes: list[int], words: DataFrame, high: int) -> DataFrame:
    """doc_id, text_key, at, hash of word positions whose shingle the filter lets through: all that some window has and few others. No shuffle."""
    rows = _positions(docs, sizes, outer=False).select("doc_id", "text_key", "at", "hash", F.shiftrightunsigned("hash", 64 - high).alias("slot"))
    own = _bits(F.col("hash"))
    return rows.join(F.broadcast(words), "slot").where(F.col("word").bitwiseAND(own) == own).select("doc_id", "text_key", "at", "hash")


def _prefixes(own: DataFrame, seen: DataFrame) -> DataFrame:
    """hash, many, inner_at, window, window_id: each window's rarest shingle, if the corpus has it."""
    rank = own.select("window_id", "words", F.explode("tokens").alias("t")).select("window_id", "words", "t.at", "t.hash").join(seen, "hash", "left")
    order = F.struct(F.coalesce("many", F.lit(0)).alias("many"), "hash", "at")
    prefix = rank.groupBy("window_id").agg(F.first("words").alias("window"), F.min(order).alias("t")).where("t.many > 0")
    return prefix.select(F.col("t.hash").alias("hash"), F.col("t.many").alias("many"), F.col("t.at").alias("inner_at"), "window", "window_id")


def _verified(rows: DataFrame, start: Column) -> DataFrame:
    """Rows with hit: whether the window stands at start in w, word by word."""
    fits = (start >= 0) & (start + F.size("window") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    return rows.withColumn("hit", F.coalesce(fits, F.lit(False)))


def _occurrences(texts: DataFrame, own: DataFrame, sizes: list[int], small: bool, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, n_words, start, end, window_id of each occurrence, and a row without a window for other texts. Reads ``texts`` twice."""
    tokens = own.select(F.explode("tokens.hash").alias("hash")).distinct()
    if small:
        counts = _positions(texts.select("w"), sizes, outer=False).join(F.broadcast(tokens), "hash").groupBy("hash").agg(F.count("*").alias("many"))
        prefix = scratch.table(_prefixes(own, counts), "prefixes")
        rows = _positions(texts, sizes, outer=True).join(F.broadcast(prefix.drop("many")), "hash", "left").withColumn("start", F.col("at") - F.col("inner_at"))
        rows = _verified(rows, F.col("start")).where("hit or at is null or at = 0")
    else:
        words_, high = shingle_filter(tokens, tokens.count())
        matched = scratch.table(_matched(texts, sizes, scratch.table(words_, "filter"), high), "matched")
        prefix = scratch.table(_prefixes(own, matched.groupBy("hash").agg(F.count("*").alias("many"))), "prefixes")
        pairs = join_salted(matched, prefix, ["hash"], F.xxhash64("doc_id", "at"), matched.count())
        pairs = pairs.select("doc_id", "text_key", (F.col("at") - F.col("inner_at")).alias("start"), "window", "window_id").where("start >= 0")
        rows = texts.alias("t").join(pairs.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("t.text_key").eqNullSafe(F.col("p.text_key")), "left").select("t.*", "p.start", "p.window", "p.window_id")
        rows = _verified(rows, F.col("start"))
    hit = F.col("hit")
    rows = rows.select("doc_id", "text_key", F.size("w").cast("bigint").alias("n_words"), F.when(hit, F.col("start")).alias("start"), F.when(hit, F.col("start") + F.size("window")).alias("end"), F.when(hit, F.col("window_id")).alias("window_id"))
    return scratch.table(rows, "found")


def occurrences(docs: DataFrame, items: DataFrame, window: int, shingle: int, most_broadcast: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words, start, end, window_id of each occurrence, and a row without a window for other texts; item_id, window_id)."""
    each = scratch.table(windows_of(items, window), "item-windows")
    own = each.select("words").distinct().withColumn("window_id", F.monotonically_increasing_id())
    named = scratch.table(shingles_of(own, shingle), "windows")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    stats = named.groupBy("size").agg(F.count("*").alias("count")).collect()  # shingle rows at most
    sizes, n_windows = sorted(r["size"] for r in stats), sum(r["count"] for r in stats)
    if sizes:
        found = _occurrences(texts, named, sizes, n_windows <= most_broadcast, scratch)
    else:
        none = F.lit(None)
        found = texts.select("doc_id", "text_key", F.size("w").cast("bigint").alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("bigint").alias("window_id"))
    return found, each.join(named.select("words", "window_id"), "words").select("item_id", "window_id")


def find(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, most_broadcast: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, text_key, n_words, spans (ascending start, end of window occurrences), item_ids."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    key = ["doc_id", "text_key"]
    found, members = occurrences(docs, items, window, shingle, most_broadcast, scratch)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    spans = found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"))
    which = scratch.table(found.where("window_id is not null").select(*key, "window_id").distinct(), "which")
    of = scratch.table(members.join(which.groupBy("window_id").agg(F.count("*").alias("many")), "window_id"), "members")
    got = join_salted(which, of, ["window_id"], F.xxhash64(*key), which.count()).groupBy(*key).agg(F.collect_set("item_id").alias("item_ids"))
    out = spans.alias("s").join(got.alias("g"), F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("s.text_key").eqNullSafe(F.col("g.text_key")), "left")
    return out.select("s.doc_id", "s.text_key", "s.n_words", "s.spans", F.coalesce("g.item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def covered(spans: Column) -> Column:
    """How many positions ascending spans cover."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(spans, zero, add, lambda s: s["n"])


def report(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    hit = covered(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, most_broadcast: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """The documents, all columns as they are, without those in which an item's window occurs."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    found, _ = occurrences(docs, items, window, shingle, most_broadcast, scratch)
    bad = scratch.table(found.where("window_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= 10 * most_broadcast else bad  # two numbers a row
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
