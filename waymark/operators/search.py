"""Text search over the index, for a batch of queries at once.

queries: q_id, words (normalised).  Every step is a join on (token, mult) and an
aggregation by query, so a batch of any size takes the same few shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import text
from waymark.plans import index as plan
from waymark.plans.store import Scratch
from waymark.sources import sinks

# How many results, merges, corrections and combinations a search considers.
MAX_REFS = 1024
MAX_MERGES = 32
MAX_INTERSECTIONS = 1024
MAX_PRODUCTIVE = 32
SALTS = 32


@dataclass
class Index:
    """posting: mult, token, idx, exact; vocab: mult, token, n_exact, n_approx; strings: idx, code.

    scratch: where a search writes its steps; without it each step's plan holds all
    steps before it.
    """

    posting: DataFrame
    vocab: DataFrame
    strings: DataFrame
    scratch: Scratch

    @classmethod
    def build(cls, strings: DataFrame, synonyms: DataFrame | None = None) -> Index:
        """Index of strings (idx, code, text), written."""
        scratch = Scratch(strings.sparkSession, "index")
        strings = scratch.table(strings, "strings")
        posting = scratch.table(plan.postings(strings, synonyms), "posting")
        return cls(posting, scratch.table(plan.vocabulary(posting), "vocab"), strings, scratch)

    def save(self, root: str, version: str) -> None:
        """The tables as a version under ``root``, postings laid out by token, and then the current one."""
        parts = int(self.posting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sinks.save_snapshot({"posting": plan.clustered(self.posting, parts), "vocab": self.vocab, "strings": self.strings}, root, version)

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: str | None = None) -> Index:
        """A saved version, the current one unless named."""
        t = sinks.load_snapshot(spark, root, ["posting", "vocab", "strings"], version)
        return cls(t["posting"], t["vocab"], t["strings"], Scratch(spark, "index"))

    def of_tokens(self, tokens: DataFrame) -> Index:
        """An index that has all that tokens (token) find here."""
        return self


class AskedIndex(Index):
    """Strings whose postings are made for the tokens that whole phrases ask, when they ask; it has no words to correct others with."""

    @classmethod
    def build(cls, strings: DataFrame) -> AskedIndex:
        """Of strings (idx, code, text) whose idx does not repeat."""
        scratch = Scratch(strings.sparkSession, "asked")
        return cls(None, None, scratch.table(strings, "strings"), scratch)

    def of_tokens(self, tokens: DataFrame) -> Index:
        posting = self.scratch.keep(plan.postings_of(self.strings, tokens))
        return Index(posting, self.scratch.keep(plan.vocabulary(posting)), self.strings, self.scratch)


def token_lookup(tokens: DataFrame, posting: DataFrame) -> DataFrame:
    """q_id, token, mult, idx, exact of (q_id, token, mult)."""
    return tokens.join(posting, ["token", "mult"])


def intersect(phrases: DataFrame, index: Index, allowed: DataFrame | None = None, limit: int = MAX_REFS) -> DataFrame:
    """Strings that have every token of a phrase.

    phrases: q_id, v (variant), words, exact_words (words that must match whole).
    Returns q_id, v, idx, level: a token that matches a string only as a prefix
    though some string has it whole adds 1.  At most ``limit`` a variant, by
    (level, idx); ``allowed`` (codes) filters before the limit.
    """
    tokens = phrases.select("q_id", "v", F.explode(text.search_tokens(F.col("words"))).alias("t"), "exact_words", F.size(F.array_distinct("words")).alias("n"))
    tokens = tokens.select("q_id", "v", "n", "t.token", "t.mult", F.array_contains("exact_words", F.col("t.token")).alias("whole"))
    index = index.of_tokens(tokens)
    # Only the strings of a phrase's rarest token are looked up for the others, so a word of very many strings costs no more than a rare one.
    own = Window.partitionBy("q_id", "v")
    refs_of = F.col("n_exact") + F.when(F.col("whole"), 0).otherwise(F.col("n_approx"))
    known = tokens.join(index.vocab, ["token", "mult"]).withColumn("known", F.count("*").over(own)).where("known = n").withColumn("place", F.row_number().over(own.orderBy(refs_of, "token"))).drop("known")
    rarest = known.where("place = 1").join(index.posting, ["token", "mult"]).where("exact or not whole").select("q_id", "v", "idx").distinct()
    refs = rarest.join(known, ["q_id", "v"]).join(index.posting, ["token", "mult", "idx"]).where("exact or not whole")
    per_ref = refs.groupBy("q_id", "v", "n", "token", "idx").agg(F.min(F.when(F.col("exact") | (F.col("n_exact") == 0), 0).otherwise(1)).alias("level"))
    hits = per_ref.groupBy("q_id", "v", "n", "idx").agg(F.count("*").alias("found"), F.sum("level").alias("level")).where("found = n").select("q_id", "v", "idx", "level")
    if allowed is not None:
        hits = hits.join(index.strings.join(allowed.select("code"), "code", "left_semi").select("idx"), "idx", "left_semi")
    # A query that very many strings answer is cut in SALTS parts first, so no task sorts all of its rows.
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("q_id", "v", "salt").orderBy("level", "idx"))
    salted = salted.withColumn("k", part).where(F.col("k") <= limit).drop("k", "salt")
    rank = F.row_number().over(Window.partitionBy("q_id", "v").orderBy("level", "idx"))
    return salted.withColumn("k", rank).where(F.col("k") <= limit).withColumn("pos", F.col("k") - 1).drop("k")


def merge_variants(queries: DataFrame) -> DataFrame:
    """All ways to join neighbouring words, fewest first by number: bit k of v, from the top, joins words k and k + 1."""
    n = F.size("words")
    count = F.least(F.lit(MAX_MERGES).cast("bigint"), F.expr("shiftleft(1L, least(size(words) - 1, 40))"))
    rows = queries.where(n > 0).select("q_id", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("v"))
    joined = F.expr("aggregate(sequence(1, size(words) - 1), array(words[0]), (acc, k) -> if((v & shiftleft(1L, size(words) - 1 - k)) > 0, concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), words[k]))), concat(acc, array(words[k]))))")
    phrase = F.when(F.size("words") == 1, F.col("words")).otherwise(joined)
    return rows.select("q_id", "v", phrase.alias("phrase"), F.size("words").alias("n")).select("q_id", "v", F.col("phrase").alias("words"), F.array().cast("array<string>").alias("exact_words"), (F.col("n") - F.size("phrase")).alias("edit_distance"))


def exact_search(queries: DataFrame, index: Index, allowed: DataFrame | None = None, limit: int = MAX_REFS) -> DataFrame:
    """q_id, v, edit_distance, idx, level, pos: results of each query's first variant that has any."""
    keep = index.scratch.keep
    none = F.array().cast("array<string>")
    whole = queries.where(F.size("words") > 0).select("q_id", F.lit(0).cast("bigint").alias("v"), "words", none.alias("exact_words"))
    plain = keep(intersect(whole, index, allowed, limit))
    # Only the queries without an answer are spread to their variants, and the postings read again only if there are any.
    left = keep(queries.where(F.size("words") > 1).join(plain.select("q_id").distinct(), "q_id", "left_anti"))
    hits = plain if left.isEmpty() else plain.unionByName(keep(intersect(merge_variants(left).where("v > 0"), index, allowed, limit)))
    # A variant's number has a bit for each join.
    first = hits.groupBy("q_id").agg(F.min("v").alias("v"))
    return hits.join(first, ["q_id", "v"]).select("q_id", "v", F.bit_count("v").cast("int").alias("edit_distance"), "idx", "level", "pos")


def _pairs_within(tokens: DataFrame, vocab: DataFrame, errors: int) -> DataFrame:
    """(token, mult, most) with words of the vocabulary within ``most`` <= errors edits: token, mult, word, edit_distance, n_exact.

    Both sides emit what their word becomes by deletions; candidates meet in an
    equi-join on those, and each pair is measured once.
    """
    left = tokens.select("token", "mult", "most", F.explode(F.when(F.col("most") >= errors, text.deletions(F.col("token"), errors)).when(F.col("most") >= 1, text.deletions(F.col("token"), 1)).otherwise(F.array("token"))).alias("key"))
    right = vocab.where("n_exact > 0").select(F.col("token").alias("word"), "mult", "n_exact", F.explode(text.deletions(F.col("token"), errors)).alias("key"))
    met = left.join(right, ["mult", "key"]).where(F.abs(F.length("token") - F.length("word")) <= F.col("most")).select("token", "mult", "most", "word", "n_exact").distinct()
    return met.withColumn("edit_distance", F.levenshtein("token", "word")).where("edit_distance <= most").drop("most")


def fuzzy_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Corrections of (token, mult, most): token, mult, word, edit_distance, n_refs.

    A token that begins some word stands for itself at distance 0; every whole
    word within ``most`` edits corrects it.
    """
    tokens = tokens.distinct()
    own = tokens.join(vocab, ["token", "mult"]).select("token", "mult", F.col("token").alias("word"), F.lit(0).alias("edit_distance"), F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_approx")).alias("n_refs"))
    near = _pairs_within(tokens.where("most > 0"), vocab, 2).where("edit_distance > 0").select("token", "mult", "word", "edit_distance", F.col("n_exact").alias("n_refs"))
    return own.unionByName(near)


def _in_common(readings: DataFrame, index: Index, open_last: bool) -> DataFrame:
    """Adds n_refs, how many strings have all words of a reading (mult, words); readings without any go.

    open_last: the last word may match as a prefix if no string has it whole.
    """
    key = ["mult", "words"]
    each = readings.select(*key).distinct().select(*key, F.size("words").alias("n"), F.posexplode("words").alias("at", "token"))
    refs = each.join(index.vocab.select("token", "mult", "n_exact"), ["token", "mult"]).join(index.posting, ["token", "mult"])
    whole = F.col("exact")
    if open_last:
        whole = whole | ((F.col("at") == F.col("n") - 1) & (F.col("n_exact") == 0))
    shared = refs.where(whole).select(*key, "n", "at", "idx").distinct().groupBy(*key, "n", "idx").agg(F.count("*").alias("found")).where("found = n")
    return readings.join(shared.groupBy(*key).agg(F.count("*").alias("n_refs")), key)


#: How many errors a token (with its mult) may have, as a column.
Bound = Callable[[Column, Column], Column]


def split_tokens(tokens: DataFrame, index: Index, bound_of: Bound = text.token_edit_distance) -> DataFrame:
    """Ways to read a token without any correction as several words: token, mult, words, edit_distance, splits, n_refs.

    Each step cuts a head that is a whole word within its own allowed distance, at
    one more for the space, and looks the rest up as a fuzzy token; some string must
    have all words. Steps go on until no rest is left; each makes it shorter.
    """
    keep = index.scratch.keep
    start = keep(tokens.distinct().join(fuzzy_tokens(tokens, index.vocab).select("token", "mult").distinct(), ["token", "mult"], "left_anti"))
    front = start.select("token", "mult", "most", F.col("token").alias("rest"), F.array().cast("array<string>").alias("words"), F.lit(0).alias("edit_distance"))
    found, step = None, -1
    while not front.isEmpty() or found is None:
        step += 1
        bound = F.least(F.col("most"), bound_of(F.col("rest"), F.lit(1)))
        if step:  # the rest as one word
            looked = front.withColumn("bound", bound)
            whole = fuzzy_tokens(looked.select(F.col("rest").alias("token"), "mult", F.col("bound").alias("most")), index.vocab)
            whole = whole.select(F.col("token").alias("rest"), "mult", "word", F.col("edit_distance").alias("own"))
            ends = looked.join(whole, ["rest", "mult"]).where(F.col("own") <= F.col("bound"))
            ends = ends.select("token", "mult", F.concat("words", F.array("word")).alias("words"), (F.col("edit_distance") + F.col("own")).alias("edit_distance"), F.lit(step).alias("splits"))
            ends = keep(_in_common(ends, index, open_last=True))
            found = ends if found is None else found.unionByName(ends)
        cut = front.where(F.length("rest") > 1).withColumn("bound", bound if step else F.col("most"))
        cut = cut.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("rest") - 1))).withColumn("head", F.substr("rest", F.lit(1), F.col("i"))).withColumn("tail", F.substr("rest", F.col("i") + 1))
        heads = _pairs_within(cut.select(F.col("head").alias("token"), "mult", F.lit(2).alias("most")).distinct(), index.vocab, 2).select(F.col("token").alias("head"), "mult", "word", F.col("edit_distance").alias("own"))
        nxt = cut.join(heads, ["head", "mult"]).where(F.col("own") <= F.least(F.col("bound"), bound_of(F.col("word"), F.lit(1))))
        nxt = nxt.select("token", "mult", "most", F.col("tail").alias("rest"), F.concat("words", F.array("word")).alias("words"), (F.col("edit_distance") + F.col("own") + 1).alias("edit_distance"))
        # Words in another order find the same strings: of those with one rest the cheapest goes on, so a token of equal letters does not multiply.
        best = Window.partitionBy("token", "mult", F.array_sort("words"), "rest").orderBy("edit_distance", "words")
        nxt = nxt.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
        front = keep(_in_common(nxt, index, open_last=False).drop("n_refs"))
    cheapest = Window.partitionBy("token", "mult", "words").orderBy("edit_distance")
    return found.withColumn("k", F.row_number().over(cheapest)).where("k = 1").drop("k")


def fuzzy_search(queries: DataFrame, index: Index, allowed: DataFrame | None = None, limit: int = MAX_REFS, bound_of: Bound = text.token_edit_distance) -> DataFrame:
    """q_id, v, edit_distance, idx, level, pos by corrections and splits of the tokens.

    Combinations of one reading for each token go by total distance, then by the
    readings' places; those that have results count, up to MAX_PRODUCTIVE of them. A token has at most 2 errors,
    and no more than ``bound_of`` allows.
    """
    tokens = queries.select("q_id", F.posexplode(text.search_tokens(F.col("words"))).alias("at", "t")).select("q_id", "at", "t.token", "t.mult").withColumn("most", F.least(bound_of(F.col("token"), F.col("mult")), F.lit(2)))
    keep = index.scratch.keep
    tokens = keep(tokens)
    asked = tokens.select("token", "mult", "most").distinct()
    none = F.array().cast("array<string>")
    direct = fuzzy_tokens(asked, index.vocab).select("token", "mult", F.array("word").alias("words"), F.when(F.col("edit_distance") > 0, F.array("word")).otherwise(none).alias("exact_words"), "edit_distance", F.lit(0).alias("splits"), "n_refs")
    split = split_tokens(asked, index, bound_of).select("token", "mult", "words", none.alias("exact_words"), "edit_distance", "splits", "n_refs")
    place = Window.partitionBy("token", "mult").orderBy("edit_distance", F.desc("splits"), F.desc("n_refs"), "words")
    # A reading with MAX_INTERSECTIONS better ones is in none of the combinations that count.
    readings = keep(direct.unionByName(split).withColumn("place", F.row_number().over(place) - 1).where(F.col("place") < MAX_INTERSECTIONS))
    rows = tokens.join(readings, ["token", "mult"])
    complete = rows.groupBy("q_id").agg(F.count_distinct("at").alias("n")).join(tokens.groupBy("q_id").agg(F.count("*").alias("n")), ["q_id", "n"], "left_semi").select("q_id")
    options = rows.join(complete, "q_id", "left_semi").groupBy("q_id", "at").agg(F.sort_array(F.collect_list(F.struct("edit_distance", "place", "words", "exact_words"))).alias("options"))
    plan = options.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "options"))), lambda r: r["options"]).alias("slots"))
    combined = plan.select("q_id", F.explode(_combinations(F.col("slots"))).alias("c")).select("q_id", "c.*")
    number = F.row_number().over(Window.partitionBy("q_id").orderBy("edit_distance", "place", "words")) - 1
    phrases = keep(combined.withColumn("v", number.cast("bigint")).where(F.col("v") < MAX_INTERSECTIONS))
    hits = keep(intersect(phrases.select("q_id", "v", "words", "exact_words"), index, allowed, limit))
    counts = hits.groupBy("q_id", "v").agg(F.count("*").alias("n"))
    before = Window.partitionBy("q_id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("found", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("productive", F.count("*").over(before)).where((F.col("found") < limit) & (F.col("productive") < MAX_PRODUCTIVE))
    return hits.join(kept.select("q_id", "v"), ["q_id", "v"], "left_semi").join(phrases.select("q_id", "v", "edit_distance"), ["q_id", "v"]).select("q_id", "v", "edit_distance", "idx", "level", "pos")


def _combinations(slots: Column) -> Column:
    """One option of each slot; after every slot the MAX_INTERSECTIONS cheapest stay."""
    kind = "array<struct<edit_distance:int,place:int,words:array<string>,exact_words:array<string>>>"
    none = F.array().cast("array<string>")
    empty = F.array(F.struct(F.lit(0).alias("edit_distance"), F.lit(0).alias("place"), none.alias("words"), none.alias("exact_words"))).cast(kind)

    def add(done: Column, options: Column) -> Column:
        # Both are in order, so (i + 1) * (j + 1) - 1 pairs are no dearer than the pair of i and j.
        fits = lambda i: F.floor(F.lit(MAX_INTERSECTIONS) / (i + 1)).cast("int")
        both = F.flatten(F.transform(done, lambda d, i: F.transform(F.slice(options, F.lit(1), fits(i)), lambda o: F.struct((d["edit_distance"] + o["edit_distance"]).alias("edit_distance"), (d["place"] + o["place"]).alias("place"), F.concat(d["words"], o["words"]).alias("words"), F.concat(d["exact_words"], o["exact_words"]).alias("exact_words")))))
        return F.slice(F.sort_array(both), 1, MAX_INTERSECTIONS).cast(kind)

    return F.aggregate(slots, empty, add)


def rank(words: Column, written: Column, past: Column | None = None) -> Column:
    """10 bits, 0 the best: words that follow in sequence (high) and that match whole (low).

    written: array of the objects' word arrays in written order; past: array of the
    past names' word arrays, each of which may rank better.
    """
    n = F.least(F.size(words), F.lit(32))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("seq"), F.lit(0).alias("whole"))

    def step(s: Column, name: Column) -> Column:
        asked = F.get(words, s["i"])
        hit = F.coalesce(F.startswith(name, asked), F.lit(False))
        after = F.struct((s["i"] + F.when(hit, 1).otherwise(0)).alias("i"), (s["seq"] + F.when(hit, 1).otherwise(-1)).alias("seq"), (s["whole"] + F.when(hit & (F.length(name) == F.length(asked)), 1).otherwise(0)).alias("whole"))
        return F.when(s["i"] < n, after).otherwise(s)

    def through(s: Column, names: Column) -> Column:
        return F.aggregate(names, s, step, lambda x: F.struct(x["i"].alias("i"), F.greatest(x["seq"], F.lit(0)).alias("seq"), x["whole"].alias("whole")))

    score = lambda s: F.shiftleft(n - s["seq"], 5).bitwiseOR(n - s["whole"])
    best = F.aggregate(written, zero, lambda s, names: F.when(s["i"] < n, through(s, names)).otherwise(s), score)
    if past is None:
        return best
    return F.least(best, F.array_min(F.transform(past, lambda names: score(through(zero, names)))))


def top_codes(hits: DataFrame, queries: DataFrame, index: Index, ranked: DataFrame, limit: Column | int = 20) -> DataFrame:
    """q_id, place, code, edit_distance, rank: each query's best codes.

    A code counts at its smallest edit distance; then by rank and by place among
    that group's results.  ranked: code, written (word arrays), past (word arrays or null).
    """
    order = F.struct("edit_distance", "v", "pos")
    codes = hits.join(index.strings.select("idx", "code"), "idx").groupBy("q_id", "code").agg(F.min(order).alias("o"))
    rows = codes.join(ranked, "code").join(queries.select("q_id", F.col("words").alias("asked"), *([] if isinstance(limit, int) else [limit.alias("most")])), "q_id")
    rows = rows.select("q_id", "code", F.col("o.edit_distance").alias("edit_distance"), "o.v", "o.pos", rank(F.col("asked"), F.col("written"), F.col("past")).alias("rank"), *([] if isinstance(limit, int) else ["most"]))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("edit_distance", "v", "rank", "pos", "code"))
    out = rows.withColumn("place", place).where(F.col("place") <= (F.lit(limit) if isinstance(limit, int) else F.col("most")))
    return out.select("q_id", "place", "code", "edit_distance", "rank")


def search(queries: DataFrame, index: Index, ranked: DataFrame, allowed: DataFrame | None = None, limit: Column | int = 20, bound_of: Bound = text.token_edit_distance) -> DataFrame:
    """Answers of text queries (q_id, text): exact, else with merged words, else with corrections within ``bound_of``."""
    asked = queries.withColumn("words", text.normalize(text.cut_query(F.col("text")))).where(F.size("words") > 0)
    exact = index.scratch.keep(exact_search(asked, index, allowed))
    left = index.scratch.keep(asked.join(exact.select("q_id").distinct(), "q_id", "left_anti"))
    hits = exact if left.isEmpty() else exact.unionByName(fuzzy_search(left, index, allowed, bound_of=bound_of))
    return top_codes(hits, asked, index, ranked, limit)


def ranking_words(paths: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """code, written, past for top_codes, from objects with paths."""
    from waymark.plans.gazetteer import in_written_order

    written = F.transform(in_written_order(F.col("path")), lambda o: text.normalize(o["name"]))
    rows = paths.select("code", written.alias("written"))
    if history is None:
        return rows.withColumn("past", F.lit(None).cast("array<array<string>>"))
    past = history.groupBy("code").agg(F.collect_list(text.normalize(F.col("text"))).alias("past"))
    return rows.join(past, "code", "left")
