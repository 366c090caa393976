"""Line dedup: a suffix array over line IDs, DataFrame operations only.

A document is a sequence of lines that hold a word.  Lines found once in the corpus
end every repeated run, so only the sequences between them count, if they have
``min_words`` words.

1. A line ID is the rank of the line's digest among repeated ones.
2. Distributed prefix doubling: the rank of 2**(k+1) lines is the place of the pair
   (rank of its first 2**k lines, rank of the next 2**k lines) among all such pairs that
   occur twice or more, in their order.  Rank k sorts the suffixes by their first 2**k lines.
   A suffix leaves the rounds where its pair is found once, or where more lines could only
   lengthen a run that counts already; at most log2(min_words) rounds follow.
3. Suffixes whose longest common prefix has L lines or more are an interval of the suffix
   array; the ranks of the two overlapping 2**k runs that cover L lines name it.  Every
   maximal repeated run is the union of runs that are minimal from their first or to their
   last line, so the intervals at these lengths suffice.
4. In each interval the first copy by (doc_id, line) stays, and the lines of every later copy
   are deleted.

Each round is a written table; memory does not depend on the length of a document. A line,
pair or interval with a large share of all rows is joined apart (``join_split``).

Defined results: null stays null, and empty texts stay; blank lines never match,
and go with the line before them; lines are compared as they are, however long; rows of
equal doc_id and equal text are one document and keep equal results; of equal runs in
documents of equal doc_id the one of the smaller hash of the text counts as first; null
doc_ids come first; an empty table gives no rows; other columns pass through, but one named
removed_lines is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm._store import Scratch, join_split

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
DOC = ["doc_id", "key"]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, j (place among lines with a word), first_line, end_line (of the text), digest, n (words)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), F.split("text", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    own = texts.select(*DOC, F.size("lines").alias("n_raw"), F.filter(numbered, lambda r: r["x"].rlike(WORD)).alias("own"))
    ended = F.transform("own", lambda r, k: F.struct(r["i"].alias("i"), F.coalesce(F.get("own", k + 1)["i"], F.col("n_raw")).alias("end"), r["x"].alias("x")))
    rows = own.select(*DOC, F.posexplode(ended).alias("j", "own"))
    n = F.size(F.split(F.btrim("own.x", F.lit(SPACE)), GAP))
    return rows.select(*DOC, "j", F.col("own.i").alias("first_line"), F.col("own.end").alias("end_line"), F.unhex(F.md5(F.col("own.x").cast("binary"))).alias("digest"), n.alias("n"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, many, rank of the keys that two rows or more have; ranks ascend with the keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("many")).where("many > 1").orderBy(*keys).withColumn("rank", F.monotonically_increasing_id())


def _sequences(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Repeated lines with their ranks, in sequences of min_words words or more; ahead, behind: lines of the minimal runs from and to each."""
    lines = scratch.table(_lines(docs), "lines")
    ids = scratch.table(_ranked(lines, ["digest"]), "ids")
    rows = join_split(lines, ids, ["digest"], lines.count()).select(*DOC, "j", "first_line", "end_line", "n", "rank").dropDuplicates([*DOC, "j"])
    rows = rows.withColumn("sequence", F.col("j") - F.row_number().over(Window.partitionBy(*DOC).orderBy("j")))
    own = Window.partitionBy(*DOC, "sequence")
    rows = rows.withColumn("upto", F.sum("n").over(own.orderBy("j"))).withColumn("all", F.sum("n").over(own)).where(F.col("all") >= min_words)
    rows = rows.withColumn("before", F.col("upto") - F.col("n"))
    # Each line has a word, so the sums ascend, and a range of them is a range of lines.
    ahead = F.count("*").over(own.orderBy("before").rangeBetween(0, min_words - 1))
    behind = F.count("*").over(own.orderBy("upto").rangeBetween(1 - min_words, 0))
    rows = rows.withColumn("ahead", F.when(F.col("all") - F.col("before") >= min_words, ahead)).withColumn("behind", F.when(F.col("upto") >= min_words, behind))
    return scratch.table(rows.select(*DOC, "j", "first_line", "end_line", "before", "upto", "ahead", "behind", "rank"), "sequences")


def suffix_ranks(sequences: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """k, doc_id, key, j, first_line, end_line (of the run's last line) and rank of every repeated run of 2**k lines that the intervals need."""
    kept = [*DOC, "j", "first_line", "end_line", "before", "upto", "rank"]
    levels, total = [sequences.select(*kept)], sequences.count()
    while 2 ** len(levels) <= min_words:
        half = 2 ** (len(levels) - 1)
        there = Window.partitionBy(*DOC).orderBy("j").rangeBetween(half, half)
        after = F.first(F.struct(F.col("rank").alias("second"), "end_line", "before")).over(there)
        pairs = levels[-1].withColumn("after", after).where("after is not null")
        # A run longer than its words need has min_words words between its first and its last line.
        pairs = pairs.select(*DOC, "j", "first_line", "after.end_line", "after.before", "upto", F.col("rank").alias("first"), "after.second").where(F.col("before") - F.col("upto") < min_words)
        ranks = scratch.table(_ranked(pairs, ["first", "second"]), f"ranks{len(levels)}")
        if ranks.isEmpty():
            break
        levels.append(scratch.table(join_split(pairs, ranks, ["first", "second"], total).select(*kept), f"level{len(levels)}"))
    named = [level.select(F.lit(k).alias("k"), *DOC, "j", "first_line", "end_line", "rank") for k, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, named)


def repeated_runs(docs: DataFrame, min_words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, key, first_line, end_line of every later copy of a minimal repeated run, as line numbers of the text."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    sequences = _sequences(docs, min_words, scratch)
    ranks = suffix_ranks(sequences, min_words, scratch)
    both = F.array(F.struct(F.col("j").alias("a"), F.col("ahead").alias("len")), F.struct((F.col("j") - F.col("behind") + 1).alias("a"), F.col("behind").alias("len")))
    runs = sequences.select(*DOC, F.explode(F.array_distinct(both)).alias("run")).select(*DOC, "run.a", "run.len").where("len is not null")
    levels = [i for i in range(1, min_words.bit_length()) if 2**i <= min_words]
    runs = runs.withColumn("k", reduce(lambda k, i: k + (F.col("len") >= 2**i).cast("int"), levels, F.lit(0)))
    runs = runs.withColumn("b", F.col("a") + F.col("len") - F.expr("shiftleft(1, k)"))
    head = ranks.select("k", *DOC, F.col("j").alias("a"), "first_line", F.col("rank").alias("head"))
    tail = ranks.select("k", *DOC, F.col("j").alias("b"), "end_line", F.col("rank").alias("tail"))
    on = lambda end: [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("k", *DOC, end)]
    runs = runs.alias("r").join(head.alias("x"), on("a")).select("r.*", "x.first_line", "x.head")
    runs = runs.alias("r").join(tail.alias("x"), on("b")).select("r.doc_id", "r.key", "r.a", "r.len", "r.first_line", "x.end_line", "r.head", "x.tail")
    runs = scratch.table(runs.withColumn("at", F.struct(*DOC, "a")), "runs")
    interval = ["len", "head", "tail"]
    first = scratch.table(runs.groupBy(*interval).agg(F.count("*").alias("many"), F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last"), "intervals")
    return join_split(runs, first, interval, runs.count()).where("at <> first").select(*DOC, "first_line", "end_line")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, key, cuts: spans that overlap or touch made one, as an ascending array."""
    by = Window.partitionBy(*DOC).orderBy("first_line", "end_line")
    reach = F.max("end_line").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("first_line") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*DOC, "part").agg(F.min("first_line").alias("first_line"), F.max("end_line").alias("end_line"))
    return rows.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first_line", "end_line"))).alias("cuts"))


def _without(text: Column, cuts: Column) -> Column:
    """The text's lines outside ascending cuts."""
    lines = F.split(text, "\n", -1)
    start = lambda i: F.coalesce(F.get(cuts, i - 1)["end_line"], F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(lines, start(i) + 1, F.greatest(F.coalesce(F.get(cuts, i)["first_line"], F.size(lines)) - start(i), F.lit(0))))
    return F.array_join(F.flatten(parts), "\n")


def dedup_lines(docs: DataFrame, min_words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """The documents with later copies of repeated runs deleted from text, and removed_lines: array of (first_line, end_line)."""
    cuts = _merged(repeated_runs(docs, min_words, scratch))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("cuts").alias("_cuts"))
    own = docs.join(cuts, docs["doc_id"].cast("bigint").eqNullSafe(cuts["_id"]) & (F.xxhash64(docs["text"]) == cuts["_key"]), "left")
    spans = cuts["_cuts"]
    text = F.when(spans.isNull(), docs["text"]).otherwise(_without(docs["text"], spans))
    removed = F.coalesce(spans, F.array().cast("array<struct<first_line:int,end_line:int>>"))
    return own.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns if c != "removed_lines"], removed.alias("removed_lines"))


def has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(WORD), F.lit(False))


SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
nb AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM raw) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
sq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i FROM nb),
ahead AS (SELECT a.doc_id, a.j AS a, min(b.j) AS b FROM sq a JOIN sq b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
behind AS (SELECT b.doc_id, max(a.j) AS a, b.j AS b FROM sq a JOIN sq b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
runs AS (SELECT doc_id, a, b FROM ahead UNION SELECT doc_id, a, b FROM behind),
named AS (SELECT r.doc_id, r.a, r.b, list(s.x ORDER BY s.j) AS name FROM runs r JOIN sq s ON s.doc_id = r.doc_id AND s.j BETWEEN r.a AND r.b GROUP BY ALL),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, a) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, coalesce(s.next_i, len(raw.ls)))) AS i FROM later l JOIN sq s ON s.doc_id = l.doc_id AND s.j BETWEEN l.a AND l.b JOIN raw ON raw.doc_id = s.doc_id),
kept AS (SELECT k.doc_id, string_agg(k.x, chr(10) ORDER BY k.i) AS text, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM raw) k ANTI JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i GROUP BY k.doc_id)
SELECT raw.doc_id, CAST(coalesce(len(raw.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(raw.ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, CASE WHEN raw.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM raw LEFT JOIN kept USING (doc_id)
"""
