"""The word-prefix index as tables.

posting: mult, token, idx, exact: string idx has ``mult`` words or more that begin with
token; exact if token is one of its words.  vocab: mult, token, n_exact, n_approx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import text

#: Synonyms up to which they are broadcast; more are shuffled.
MOST_BROADCAST = 100_000


def postings(strings: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Postings of strings (idx, text). synonyms: word, synonym, both normalised single words.

    Strings are dealt by idx before their prefixes are spread, which are several times as large; the prefixes are
    then counted where they are, and nothing is shuffled by token.  Synonyms go to the postings, never the other way: the
    size that Spark estimates for postings is that of the compressed strings, which may seem small enough to broadcast.
    """
    words = strings.select("idx", "text").repartition("idx").select("idx", text.normalize(F.col("text")).alias("words"))
    counted = words.select("idx", "words", F.explode(text.all_prefixes(F.col("words"))).alias("token")).groupBy("idx", "token").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    rows = counted.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("mult"), "token", "idx", F.array_contains("words", F.col("token")).alias("exact"))
    if synonyms is None:
        return rows
    synonyms = F.broadcast(synonyms) if synonyms.count() <= MOST_BROADCAST else synonyms.hint("merge")
    extra = rows.join(synonyms, F.col("token") == F.col("word")).select("mult", F.explode(text.prefixes(F.col("synonym"))).alias("token"), "idx", F.lit(True).alias("exact"))
    return rows.unionByName(extra).distinct()


def postings_of(strings: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of postings for some tokens (token) only, of strings whose idx does not repeat.

    The distinct words are few beside the strings: their prefixes meet the tokens, and the strings' words what begins them.
    """
    words = strings.select("idx", F.explode(text.normalize(F.col("text"))).alias("word"))
    begun = words.select("word").distinct().select("word", F.explode(text.prefixes(F.col("word"))).alias("token")).join(tokens.select("token").distinct(), "token")
    rows = words.join(begun, "word").groupBy("idx", "token").agg(F.count("*").cast("int").alias("n"), F.max(F.col("word") == F.col("token")).alias("exact"))
    return rows.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("mult"), "token", "idx", "exact")


def prefix_counts(texts: DataFrame, key: str) -> DataFrame:
    """key, token, n: how many words of a text (key, text) begin with each prefix; a word that repeats is spread once."""
    words = texts.select(key, "text").repartition(key).select(key, F.explode(text.normalize(F.col("text"))).alias("w"))
    counted = words.groupBy(key, "w").agg(F.count("*").alias("k")).select(key, "k", F.explode(text.prefixes(F.col("w"))).alias("token"))
    return counted.groupBy(key, "token").agg(F.sum("k").alias("n"))


def _shared(a: Column, b: Column) -> Column:
    """How many first characters two words have in common."""
    ends = F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(a == b, F.length(a)).otherwise(F.size(ends))


def prefix_totals(texts: DataFrame, key: str) -> DataFrame:
    """key, n_prefixes, n_repeated, most: a text's distinct prefixes, how many of them occur twice or more, and the greatest count.

    Words that begin alike are neighbours in order, so the numbers follow from what neighbours share and no prefix is spread;
    a text is worked on where it is read.  Only the texts of a key that repeats are counted prefix by prefix.
    """
    again = texts.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_again"))
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again.hint("merge")
    met = F.col(key).eqNullSafe(F.col("_again"))
    counted = prefix_counts(texts.join(again, met, "left_semi"), key).groupBy(key).agg(F.count("*").alias("n_prefixes"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.max("n").alias("most"))
    own = texts.join(again, met, "left_anti").select(key, F.array_sort(text.normalize(F.col("text"))).alias("w")).where(F.size("w") > 0)
    n = F.size("w") - 1
    own = own.select(key, F.aggregate("w", F.lit(0).cast("bigint"), lambda s, w: s + F.length(w)).alias("chars"), F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), _shared).alias("shared"))
    long = lambda x: F.lit(x).cast("bigint")
    zero = F.struct(long(0).alias("last"), long(0).alias("sum"), long(0).alias("twice"), long(1).alias("run"), long(1).alias("most"))

    def add(s: Column, x: Column) -> Column:
        run = F.when(x > 0, s["run"] + 1).otherwise(long(1))
        return F.struct(x.cast("bigint").alias("last"), (s["sum"] + x).alias("sum"), (s["twice"] + F.greatest(x - s["last"], long(0))).alias("twice"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    own = own.select(key, "chars", F.aggregate("shared", zero, add).alias("s"))
    return own.select(key, (F.col("chars") - F.col("s.sum")).alias("n_prefixes"), F.col("s.twice").alias("n_repeated"), F.col("s.most").alias("most")).unionByName(counted)


def vocabulary(posting: DataFrame) -> DataFrame:
    return posting.groupBy("mult", "token").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_approx"))


def statistics(posting: DataFrame) -> DataFrame:
    """n_tokens and n_refs of each mult."""
    by_token = posting.groupBy("mult", "token").agg(F.count("*").alias("n"))
    return by_token.groupBy("mult").agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_refs"))


def invalid(posting: DataFrame) -> DataFrame:
    """Tokens without a character, and postings that are not strictly ascending; empty for a good index."""
    w = Window.partitionBy("mult", "token", "exact").orderBy("idx")
    again = posting.withColumn("before", F.lag("idx").over(w)).where(F.col("before") >= F.col("idx")).select("mult", "token", "idx", F.lit("repeated").alias("fault"))
    return again.unionByName(posting.where("token is null or token = '' or mult < 1").select("mult", "token", "idx", F.lit("token").alias("fault")))


def big_only(strings: DataFrame, objects: DataFrame, types: tuple[int, ...]) -> DataFrame:
    """The strings of objects of some types, for an index of its own."""
    return strings.join(objects.where(F.col("typ").isin(*types)).select("code"), "code", "left_semi")


def clustered(posting: DataFrame, partitions: int) -> DataFrame:
    """Postings laid out for lookups: by token, so a scan for some tokens skips the rest by its statistics."""
    return posting.repartition(partitions, "token").sortWithinPartitions("token", "mult", "idx")
