"""Column functions on names and queries: folding, words, prefixes, word statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold, and what they fold to; all other diacritics stay.
FOLD_FROM = "ēūīāšģķļžčņ"
FOLD_TO = "euiasgklzcn"
# Fixed value: word separators beside white space.
SEPARATORS = r"[\p{javaWhitespace}\-,/.\"']+"


def unaccent(text: Column) -> Column:
    """Lower case, then the folding letters."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Folded words of a text; an empty array for null."""
    return F.coalesce(split_words(unaccent(text)), F.array().cast("array<string>"))


def prefixes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.substr(word, F.lit(1), i))


def all_prefixes(words: Column) -> Column:
    """Every non-empty prefix of every word, as often as it occurs."""
    return F.flatten(F.transform(words, prefixes))


def search_stats(words: Column) -> Column:
    """Array of (word, n) in order: n is 1 + how many other words it is a prefix of.

    Of two equal words the later one counts the earlier.
    """

    def stat(word: Column, i: Column) -> Column:
        longer = F.filter(words, lambda other: F.startswith(other, word) & (F.length(other) > F.length(word)))
        twins = F.filter(F.slice(words, 1, i), lambda other: other == word)
        return F.struct(word.alias("word"), (1 + F.size(longer) + F.size(twins)).alias("n"))

    return F.transform(words, stat)


def search_tokens(words: Column) -> Column:
    """Distinct (token, mult) to look up: a word that must occur n times has mult n."""
    stats = search_stats(words)
    most = lambda w: F.array_max(F.transform(F.filter(stats, lambda s: s["word"] == w), lambda s: s["n"]))
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("token"), most(w).cast("int").alias("mult")))


def max_edit_distance(word: Column) -> Column:
    """Allowed typing errors: none in numbers and up to 2 characters, 1 up to 5, else 2."""
    n = F.length(word)
    return F.when(word.rlike(r"^[0-9]*$"), 0).when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def token_edit_distance(token: Column, mult: Column) -> Column:
    """As max_edit_distance; a number that must repeat is not taken as a number."""
    n = F.length(token)
    by_length = F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)
    return F.when(mult > 1, by_length).otherwise(max_edit_distance(token))


def deletions(word: Column, errors: int) -> Column:
    """The word and all it becomes by up to ``errors`` deletions: two words within that edit distance share one."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = level = F.array(word)
    for _ in range(errors):
        level = F.array_distinct(F.flatten(F.transform(level, cut)))
        out = F.array_union(out, level)
    return out


def bounding_box(lat: Column, long: Column) -> Column:
    # The plane's bounds.
    return lat.between(160000, 450000) & long.between(300000, 770000)


def is_code(query: Column) -> Column:
    return query.rlike(r"^\d{9}$")


def cut_query(query: Column, most: int = 256) -> Column:
    return F.substring(query, 1, most)


def words_match(text: Column, address: Column) -> Column:
    """Whether both texts' words are equal pairwise, up to the shorter one's end; case folds in the address only."""
    a, b = split_words(text), split_words(F.lower(address))
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def plain_address(address: Column) -> Column:
    return F.replace(F.replace(F.lower(address), F.lit("\n"), F.lit(", ")), F.lit('"'), F.lit(""))


def riga_to_utc(text: Column) -> Column:
    """Instant of a 'yyyy-MM-dd HH:mm:ss' text in Europe/Riga; null for null, empty or unreadable."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")), "Europe/Riga")


def utc_to_riga(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Europe/Riga"), "yyyy-MM-dd HH:mm:ss")


def file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def shown_version(path: Column) -> Column:
    """The last part of a version's path; a text of its own where there is none."""
    return F.coalesce(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), F.lit("<Not initialized>"))


def version_of(name: Column) -> Column:
    """The part of a file name before its first dot."""
    return F.substring_index(name, ".", 1)
