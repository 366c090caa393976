"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import filters, resolve, search, spatial, sync
from waymark.plans import gazetteer as g
from waymark.plans import index as plan
from waymark.plans.store import Scratch, read, shared_dir
from waymark.sources import sinks
from waymark.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- text -------------------------------------------------------------------------------

_FOLD = "translate(lower({0}), 'ēūīāšģķļžčņ', 'euiasgklzcn')"
_WORDS = r"list_filter(regexp_split_to_array(" + _FOLD + r", '[\s\-,/.\"'']+'), lambda x: x <> '')"


@query("normalize_tokens", f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)")
def normalize_tokens(spark, sf_dir):
    w = read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


_PREFIXES = f"""
pw AS (SELECT p_partkey AS idx, {_WORDS.format('p_name')} AS ws FROM part),
px AS (SELECT idx, ws, w[1:k] AS token FROM (SELECT idx, ws, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT idx, ws, unnest(ws) AS w FROM pw))),
pc AS (SELECT idx, token, count(*) AS n, list_contains(any_value(ws), token) AS exact FROM px GROUP BY idx, token),
posting AS (SELECT unnest(range(1, n + 1)) AS mult, token, idx, exact FROM pc),
vocab AS (SELECT mult, token, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_approx FROM posting GROUP BY ALL)"""


def _parts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("code"), F.col("p_name").alias("text"))


@query("prefix_stats", f"WITH {_PREFIXES} SELECT idx AS p_partkey, token, CAST(n AS INTEGER) AS n FROM pc")
def prefix_stats(spark, sf_dir):
    rows = plan.postings(_parts(spark, sf_dir)).groupBy("idx", "token").agg(F.max("mult").alias("n"))
    return rows.select(F.col("idx").alias("p_partkey"), "token", "n")


@query(
    "repeated_tokens",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents), p AS (SELECT doc_id, w[1:k] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w)),
c AS (SELECT doc_id, token, count(*) AS n FROM p GROUP BY ALL) SELECT doc_id, count(*) AS n_prefixes, count(*) FILTER (n > 1) AS n_repeated, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY doc_id""",
)
def repeated_tokens(spark, sf_dir):
    return plan.prefix_totals(read(spark, sf_dir, "documents"), "doc_id")


@query("posting_stats", f"WITH {_PREFIXES}, t AS (SELECT mult, token, count(*) AS n FROM posting GROUP BY ALL) SELECT CAST(mult AS INTEGER) AS mult, count(*) AS n_tokens, CAST(sum(n) AS BIGINT) AS n_refs FROM t GROUP BY mult")
def posting_stats(spark, sf_dir):
    return plan.statistics(plan.postings(_parts(spark, sf_dir)))


@query("vocabulary", f"WITH {_PREFIXES} SELECT CAST(mult AS INTEGER) AS mult, token, n_exact, n_approx FROM vocab")
def vocabulary(spark, sf_dir):
    return plan.vocabulary(plan.postings(_parts(spark, sf_dir)))


@query("index_faults", f"WITH {_PREFIXES} SELECT CAST(mult AS INTEGER) AS mult, token, idx, 'repeated' AS fault FROM posting GROUP BY mult, token, idx, exact HAVING count(*) > 1")
def index_faults(spark, sf_dir):
    return plan.invalid(plan.postings(_parts(spark, sf_dir)))


_SYNONYMS = [("red", "crimson"), ("blue", "azure"), ("s", "small")]


@query(
    "synonym_postings",
    f"""WITH {_PREFIXES}, syn AS (SELECT * FROM (VALUES ('red', 'crimson'), ('blue', 'azure'), ('s', 'small')) s(word, synonym)),
every AS (SELECT mult, token, idx, exact FROM posting UNION SELECT mult, synonym[1:k], idx, true FROM (SELECT mult, idx, synonym, unnest(range(1, len(synonym) + 1)) AS k FROM posting JOIN syn ON token = word))
SELECT CAST(mult AS INTEGER) AS mult, token, exact, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM every GROUP BY ALL""",
)
def synonym_postings(spark, sf_dir):
    syn = spark.createDataFrame(_SYNONYMS, "word string, synonym string")
    return plan.postings(_parts(spark, sf_dir), syn).groupBy("mult", "token", "exact").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"))


@query("edit_distances", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def edit_distances(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query(
    "max_edit_distance",
    r"WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(p_type || ' ' || p_size || ' ' || p_name, '[\s]+'), lambda x: x <> '')) AS word FROM part) SELECT word, CAST(CASE WHEN regexp_full_match(word, '[0-9]*') THEN 0 WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS INTEGER) AS most FROM w",
)
def max_edit_distance(spark, sf_dir):
    w = read(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_size", "p_name"), r"\s+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", text.max_edit_distance(F.col("word")).alias("most"))


# ---- search -------------------------------------------------------------------------------


def _index(spark, sf_dir) -> search.Index:
    return search.Index.build(_parts(spark, sf_dir))


def _names(spark, sf_dir) -> DataFrame:
    """Every distinct part name, numbered by its smallest key."""
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("q_id"))


_ASKED = """
st AS (SELECT a.q_id, a.v, a.w, max(1 + (SELECT count(*) FROM qw b WHERE b.q_id = a.q_id AND b.v = a.v AND b.i <> a.i AND starts_with(b.w, a.w) AND (length(b.w) > length(a.w) OR (b.w = a.w AND b.i < a.i)))) AS mult FROM qw a GROUP BY a.q_id, a.v, a.w),
need AS (SELECT q_id, v, count(*) AS n FROM st GROUP BY ALL),
ref AS (SELECT st.q_id, st.v, st.w, p.idx, min(CASE WHEN p.exact OR vc.n_exact = 0 THEN 0 ELSE 1 END) AS level FROM st JOIN vocab vc ON vc.token = st.w AND vc.mult = st.mult JOIN posting p ON p.token = st.w AND p.mult = st.mult GROUP BY ALL),
hit0 AS (SELECT ref.q_id, ref.v, idx, sum(level) AS level FROM ref JOIN need ON need.q_id = ref.q_id AND need.v = ref.v GROUP BY ref.q_id, ref.v, idx, need.n HAVING count(*) = need.n),
hit AS (SELECT q_id, v, idx, level, row_number() OVER (PARTITION BY q_id, v ORDER BY level, idx) - 1 AS pos FROM hit0 QUALIFY pos < 1024)"""

_CUT = "SELECT min(p_partkey) AS q_id, list_transform(string_split(lower(p_name), ' '), lambda w: w[1:2]) AS words FROM part GROUP BY p_name"


@query(
    "prefix_search",
    f"WITH {_PREFIXES}, q AS ({_CUT}), qw AS (SELECT q_id, 0 AS v, words[i] AS w, i FROM (SELECT q_id, words, unnest(range(1, len(words) + 1)) AS i FROM q)), {_ASKED} SELECT q_id, idx, CAST(level AS BIGINT) AS level, CAST(pos AS INTEGER) AS pos FROM hit",
)
def prefix_search(spark, sf_dir):
    asked = _names(spark, sf_dir).select("q_id", F.transform(text.normalize(F.col("p_name")), lambda w: F.substring(w, 1, 2)).alias("words"))
    phrases = asked.select("q_id", F.lit(0).alias("v"), "words", F.array().cast("array<string>").alias("exact_words"))
    return search.intersect(phrases, _index(spark, sf_dir)).select("q_id", "idx", "level", "pos")


_BROKEN = "SELECT min(p_partkey) AS q_id, p_name[1:2] || ' ' || p_name[3:] AS q FROM part GROUP BY p_name"
_VARIANTS = f"""
q AS (SELECT q_id, {_WORDS.format('q')} AS words FROM ({_BROKEN})),
qb AS (SELECT q_id, words, unnest(range(0, least(32, 1 << (len(words) - 1)))) AS v FROM q WHERE len(words) > 0),
qs AS (SELECT q_id, v, len(words) AS n, list_filter(string_split(string_agg(CASE WHEN i = 1 OR (v >> (len(words) - i)) & 1 = 1 THEN words[i] ELSE ' ' || words[i] END, '' ORDER BY i), ' '), lambda x: x <> '') AS words FROM (SELECT q_id, v, words, unnest(range(1, len(words) + 1)) AS i FROM qb) GROUP BY q_id, v, words),
qw AS (SELECT q_id, v, words[i] AS w, i FROM (SELECT q_id, v, words, unnest(range(1, len(words) + 1)) AS i FROM qs))"""


@query(
    "merge_search",
    f"""WITH {_PREFIXES}, {_VARIANTS}, {_ASKED}, best AS (SELECT q_id, min(v) AS v FROM hit GROUP BY q_id)
SELECT hit.q_id, CAST(hit.v AS BIGINT) AS v, CAST(qs.n - len(qs.words) AS INTEGER) AS edit_distance, hit.idx, CAST(hit.level AS BIGINT) AS level, CAST(hit.pos AS INTEGER) AS pos FROM hit JOIN best USING (q_id, v) JOIN qs USING (q_id, v)""",
)
def merge_search(spark, sf_dir):
    broken = F.concat(F.substring("p_name", 1, 2), F.lit(" "), F.expr("substring(p_name, 3)"))
    asked = _names(spark, sf_dir).select("q_id", text.normalize(broken).alias("words")).where(F.size("words") > 0)
    return search.exact_search(asked, _index(spark, sf_dir))


_TYPOS = "SELECT DISTINCT w[1:1] || w[3:] AS token FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)"


@query(
    "fuzzy_tokens",
    f"""WITH {_PREFIXES}, t AS (SELECT token, CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END AS most FROM ({_TYPOS})),
own AS (SELECT t.token, t.token AS word, 0 AS edit_distance, CASE WHEN n_exact > 0 THEN n_exact ELSE n_approx END AS n_refs FROM t JOIN vocab v ON v.token = t.token AND v.mult = 1),
near AS (SELECT t.token, v.token AS word, levenshtein(t.token, v.token) AS edit_distance, n_exact AS n_refs FROM t JOIN vocab v ON v.mult = 1 AND n_exact > 0 AND levenshtein(t.token, v.token) BETWEEN 1 AND most)
SELECT token, word, CAST(edit_distance AS INTEGER) AS edit_distance, CAST(n_refs AS BIGINT) AS n_refs FROM own UNION ALL SELECT token, word, CAST(edit_distance AS INTEGER), n_refs FROM near""",
)
def fuzzy_tokens(spark, sf_dir):
    w = read(spark, sf_dir, "part").select(F.explode(text.normalize(F.col("p_name"))).alias("w"))
    typo = w.select(F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")).alias("token")).distinct()
    asked = typo.select("token", F.lit(1).alias("mult"), text.token_edit_distance(F.col("token"), F.lit(1)).alias("most"))
    return search.fuzzy_tokens(asked, plan.vocabulary(plan.postings(_parts(spark, sf_dir)))).select("token", "word", "edit_distance", "n_refs")


_MOST = "CASE WHEN regexp_full_match({0}, '[0-9]*') THEN 0 WHEN length({0}) <= 2 THEN 0 WHEN length({0}) <= 5 THEN 1 ELSE 2 END"
# Corrections and readings as several words of tok (token, mult, most). A reading carries the strings that have all its words.
_READINGS = f"""
lists AS (SELECT mult, token, list(DISTINCT idx) FILTER (exact) AS ex, list(DISTINCT idx) FILTER (NOT exact) AS ap, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_approx FROM posting GROUP BY ALL),
direct AS (SELECT t.token, t.mult, t.token AS word, 0 AS ed, CASE WHEN n_exact > 0 THEN n_exact ELSE n_approx END AS n_refs FROM tok t JOIN lists v USING (token, mult)
  UNION ALL SELECT t.token, t.mult, v.token, levenshtein(t.token, v.token), n_exact FROM tok t JOIN lists v ON v.mult = t.mult AND n_exact > 0 AND levenshtein(t.token, v.token) BETWEEN 1 AND most),
front AS (SELECT token, mult, most, token AS rest, CAST([] AS VARCHAR[]) AS words, 0 AS ed, 0 AS step, CAST(NULL AS BIGINT[]) AS ids FROM tok ANTI JOIN direct USING (token, mult)
  UNION ALL SELECT f.token, f.mult, most, rest[i + 1:], list_append(words, v.token), ed + 1 + levenshtein(rest[1:i], v.token), step + 1, CASE WHEN ids IS NULL THEN ex ELSE list_intersect(ids, ex) END
  FROM (SELECT *, unnest(range(1, length(rest))) AS i FROM front) f JOIN lists v ON v.mult = f.mult AND n_exact > 0 AND levenshtein(rest[1:i], v.token) <= least(2, {_MOST.format('v.token')}, CASE WHEN step = 0 THEN most ELSE least(most, {_MOST.format('rest')}) END)
  WHERE ids IS NULL OR len(list_intersect(ids, ex)) > 0),
split0 AS (SELECT f.token, f.mult, list_append(words, v.token) AS words, ed + levenshtein(rest, v.token) AS ed, step AS splits, len(list_intersect(ids, CASE WHEN n_exact > 0 THEN ex ELSE ap END)) AS n_refs
  FROM front f JOIN lists v ON v.mult = f.mult AND (v.token = rest OR (n_exact > 0 AND levenshtein(rest, v.token) BETWEEN 1 AND least(most, {_MOST.format('rest')}))) WHERE step > 0),
split AS (SELECT token, mult, words, min(ed) AS ed, any_value(splits) AS splits, any_value(n_refs) AS n_refs FROM split0 WHERE n_refs > 0 GROUP BY token, mult, words)"""


@query(
    "split_tokens",
    f"""WITH RECURSIVE {_PREFIXES}, jn AS (SELECT DISTINCT array_to_string({_WORDS.format('p_name')}, '') AS token FROM part), tok AS (SELECT token, 1 AS mult, {_MOST.format('token')} AS most FROM jn), {_READINGS}
SELECT token, array_to_string(words, ' ') AS words, CAST(ed AS INTEGER) AS edit_distance, CAST(splits AS INTEGER) AS splits, CAST(n_refs AS BIGINT) AS n_refs FROM split""",
)
def split_tokens(spark, sf_dir):
    joined = _names(spark, sf_dir).select(F.array_join(text.normalize(F.col("p_name")), "").alias("token")).distinct()
    asked = joined.select("token", F.lit(1).alias("mult"), text.token_edit_distance(F.col("token"), F.lit(1)).alias("most"))
    return search.split_tokens(asked, _index(spark, sf_dir)).select("token", F.array_join("words", " ").alias("words"), "edit_distance", "splits", "n_refs")


def _ranked(index: search.Index) -> DataFrame:
    return index.strings.select("code", F.array(text.normalize(F.col("text"))).alias("written"), F.lit(None).cast("array<array<string>>").alias("past"))


_NAMES = f"SELECT min(p_partkey) AS q_id, {_WORDS.format('p_name')} AS words FROM part GROUP BY p_name"


@query(
    "rank_search",
    f"""WITH {_PREFIXES}, q AS ({_CUT}), qw AS (SELECT q_id, 0 AS v, words[i] AS w, i FROM (SELECT q_id, words, unnest(range(1, len(words) + 1)) AS i FROM q)), {_ASKED},
r AS (SELECT h.q_id, h.idx AS code, h.pos, len(q.words) AS n, q.words AS asked, pw.ws AS name FROM hit h JOIN q USING (q_id) JOIN pw ON pw.idx = h.idx),
f AS (SELECT *, 1 AS j, 0 AS i, 0 AS seq, 0 AS whole FROM r),
g AS (SELECT *, list_reduce(list_prepend({{'i': 0, 'seq': 0, 'whole': 0, 'w': ''}}, list_transform(name, lambda x: {{'i': 0, 'seq': 0, 'whole': 0, 'w': x}})), lambda s, x: CASE WHEN s.i >= n THEN s ELSE {{'i': s.i + CASE WHEN starts_with(x.w, asked[s.i + 1]) THEN 1 ELSE 0 END, 'seq': s.seq + CASE WHEN starts_with(x.w, asked[s.i + 1]) THEN 1 ELSE -1 END, 'whole': s.whole + CASE WHEN x.w = asked[s.i + 1] THEN 1 ELSE 0 END, 'w': ''}} END) AS s FROM r),
k AS (SELECT q_id, code, pos, ((n - greatest(s.seq, 0)) << 5) | (n - s.whole) AS rank FROM g)
SELECT q_id, CAST(place AS INTEGER) AS place, code, CAST(0 AS INTEGER) AS edit_distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank, pos, code) AS place FROM k) WHERE place <= 20""",
)
def rank_search(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = _names(spark, sf_dir).select("q_id", F.array_join(F.transform(text.normalize(F.col("p_name")), lambda w: F.substring(w, 1, 2)), " ").alias("text"))
    return search.search(asked, index, _ranked(index), limit=20)


_TYPED = f"SELECT min(p_partkey) AS q_id, list_transform({_WORDS.format('p_name')}, lambda w: w[1:1] || w[3:]) AS typed FROM part GROUP BY p_name"


@query(
    "fuzzy_search",
    f"""WITH RECURSIVE {_PREFIXES},
q AS (SELECT q_id, {_WORDS.format("array_to_string(typed, ' ')")} AS words FROM ({_TYPED})),
qb AS (SELECT q_id, words, unnest(range(0, least(32, 1 << (len(words) - 1)))) AS v FROM q WHERE len(words) > 0),
qs AS (SELECT q_id, v, len(words) AS n, list_filter(string_split(string_agg(CASE WHEN i = 1 OR (v >> (len(words) - i)) & 1 = 1 THEN words[i] ELSE ' ' || words[i] END, '' ORDER BY i), ' '), lambda x: x <> '') AS words FROM (SELECT q_id, v, words, unnest(range(1, len(words) + 1)) AS i FROM qb) GROUP BY q_id, v, words),
qw AS (SELECT q_id, v, words[i] AS w, i FROM (SELECT q_id, v, words, unnest(range(1, len(words) + 1)) AS i FROM qs)), {_ASKED},
first AS (SELECT q_id, min(v) AS v FROM hit GROUP BY q_id),
plain AS (SELECT hit.q_id, v, qs.n - len(qs.words) AS ed, idx, pos FROM hit JOIN first USING (q_id, v) JOIN qs USING (q_id, v)),
own AS (SELECT st.q_id, w AS token, st.mult, (SELECT min(i) FROM qw WHERE qw.q_id = st.q_id AND qw.v = 0 AND qw.w = st.w) AS nth FROM st WHERE v = 0 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.q_id = st.q_id)),
tok AS (SELECT DISTINCT token, mult, CASE WHEN mult > 1 THEN CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END ELSE {_MOST.format('token')} END AS most FROM own), {_READINGS},
reading AS (SELECT *, row_number() OVER (PARTITION BY token, mult ORDER BY ed, splits DESC, n_refs DESC, words) - 1 AS place FROM (
  SELECT token, mult, [word] AS words, CASE WHEN ed > 0 THEN [word] ELSE CAST([] AS VARCHAR[]) END AS whole, ed, 0 AS splits, n_refs FROM direct UNION ALL SELECT token, mult, words, CAST([] AS VARCHAR[]), ed, splits, n_refs FROM split)),
slot AS (SELECT q_id, dense_rank() OVER (PARTITION BY q_id ORDER BY nth) AS k, count(*) OVER (PARTITION BY q_id) AS n, token, mult FROM own),
combo AS (SELECT q_id, 1 AS k, n, r.ed, r.place, r.words, r.whole FROM slot JOIN reading r USING (token, mult) WHERE k = 1
  UNION ALL SELECT c.q_id, c.k + 1, c.n, c.ed + r.ed, c.place + r.place, c.words || r.words, c.whole || r.whole FROM combo c JOIN slot s ON s.q_id = c.q_id AND s.k = c.k + 1 JOIN reading r ON r.token = s.token AND r.mult = s.mult),
fq AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ed, place, words) - 1 AS v FROM combo WHERE k = n QUALIFY v < 1024),
fw AS (SELECT q_id, v, words[i] AS w, i, list_contains(whole, words[i]) AS strict FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM fq)),
fst AS (SELECT a.q_id, a.v, a.w, any_value(a.strict) AS strict, max(1 + (SELECT count(*) FROM fw b WHERE b.q_id = a.q_id AND b.v = a.v AND b.i <> a.i AND starts_with(b.w, a.w) AND (length(b.w) > length(a.w) OR (b.w = a.w AND b.i < a.i)))) AS mult FROM fw a GROUP BY a.q_id, a.v, a.w),
fneed AS (SELECT q_id, v, count(*) AS n FROM fst GROUP BY ALL),
fref AS (SELECT t.q_id, t.v, t.w, p.idx, min(CASE WHEN p.exact OR l.n_exact = 0 THEN 0 ELSE 1 END) AS level FROM fst t JOIN lists l ON l.token = t.w AND l.mult = t.mult JOIN posting p ON p.token = t.w AND p.mult = t.mult WHERE p.exact OR NOT strict GROUP BY ALL),
fhit0 AS (SELECT r.q_id, r.v, idx, sum(level) AS level FROM fref r JOIN fneed USING (q_id, v) GROUP BY r.q_id, r.v, idx, fneed.n HAVING count(*) = fneed.n),
fhit AS (SELECT *, row_number() OVER (PARTITION BY q_id, v ORDER BY level, idx) - 1 AS pos FROM fhit0 QUALIFY pos < 1024),
fcount AS (SELECT q_id, v, coalesce(sum(n) OVER earlier, 0) AS before, count(*) OVER earlier AS productive FROM (SELECT q_id, v, count(*) AS n FROM fhit GROUP BY ALL) WINDOW earlier AS (PARTITION BY q_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
every AS (SELECT * FROM plain UNION ALL SELECT q_id, v, fq.ed, idx, pos FROM fhit JOIN fq USING (q_id, v) JOIN fcount USING (q_id, v) WHERE before < 1024 AND productive < 32),
best AS (SELECT q_id, idx AS code, arg_min({{'ed': ed, 'v': v, 'pos': pos}}, {{'ed': ed, 'v': v, 'pos': pos}}) AS o FROM every GROUP BY q_id, idx),
r AS (SELECT b.q_id, code, o.ed AS ed, o.v AS v, o.pos AS pos, len(q.words) AS n, q.words AS asked, pw.ws AS name FROM best b JOIN q USING (q_id) JOIN pw ON pw.idx = code),
g AS (SELECT *, list_reduce(list_prepend({{'i': 0, 'seq': 0, 'whole': 0, 'w': ''}}, list_transform(name, lambda x: {{'i': 0, 'seq': 0, 'whole': 0, 'w': x}})), lambda s, x: CASE WHEN s.i >= n THEN s ELSE {{'i': s.i + CASE WHEN starts_with(x.w, asked[s.i + 1]) THEN 1 ELSE 0 END, 'seq': s.seq + CASE WHEN starts_with(x.w, asked[s.i + 1]) THEN 1 ELSE -1 END, 'whole': s.whole + CASE WHEN x.w = asked[s.i + 1] THEN 1 ELSE 0 END, 'w': ''}} END) AS s FROM r),
k AS (SELECT q_id, code, ed, v, pos, ((n - greatest(s.seq, 0)) << 5) | (n - s.whole) AS rank FROM g)
SELECT q_id, CAST(place AS INTEGER) AS place, code, CAST(ed AS INTEGER) AS edit_distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ed, v, rank, pos, code) AS place FROM k) WHERE place <= 20""",
)
def fuzzy_search(spark, sf_dir):
    index = _index(spark, sf_dir)
    typo = lambda w: F.concat(F.substring(w, 1, 1), F.substr(w, F.lit(3)))
    asked = _names(spark, sf_dir).select("q_id", F.array_join(F.transform(text.normalize(F.col("p_name")), typo), " ").alias("text"))
    return search.search(asked, index, _ranked(index), limit=20)


# ---- hierarchy -------------------------------------------------------------------------------

_GAZ = """gaz AS (
SELECT CAST(113000000 + r_regionkey AS BIGINT) AS code, 113 AS typ, r_name AS name, CAST(NULL AS BIGINT) AS super_code, CAST(NULL AS VARCHAR) AS zip_code, CAST(NULL AS DECIMAL(10,3)) AS lat, CAST(NULL AS DECIMAL(10,3)) AS long, 'A' || r_regionkey AS atvk FROM region
UNION ALL SELECT 105000000 + n_nationkey, 105, n_name, 113000000 + n_regionkey, NULL, NULL, NULL, 'B' || n_nationkey FROM nation
UNION ALL SELECT 106000000 + s_suppkey, 106, s_name, 105000000 + s_nationkey, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 108000000 + c_custkey, 108, c_name, 105000000 + c_nationkey, c_mktsegment, CAST(300000 + c_acctbal AS DECIMAL(10,3)), CAST(500000 + c_acctbal AS DECIMAL(10,3)), NULL FROM customer
UNION ALL SELECT 109000000 + o_orderkey, 109, o_orderpriority, 108000000 + o_custkey, NULL, NULL, NULL, NULL FROM orders),
up AS (SELECT code AS own, code, typ, name, super_code, zip_code, lat, long, atvk, 1 AS d FROM gaz UNION ALL SELECT up.own, g.code, g.typ, g.name, g.super_code, g.zip_code, g.lat, g.long, g.atvk, d + 1 FROM up JOIN gaz g ON up.super_code = g.code),
leaf AS (SELECT g.code, p.super_code IS NULL AS is_leaf FROM gaz g LEFT JOIN (SELECT DISTINCT super_code FROM gaz WHERE super_code IS NOT NULL) p ON p.super_code = g.code),
names AS (SELECT own AS code, max(d) AS depth, max(name) FILTER (typ = 113) AS nov, max(name) FILTER (typ = 104) AS pil, max(name) FILTER (typ = 105) AS pag, max(name) FILTER (typ = 106) AS cie, max(name) FILTER (typ = 107) AS iel, max(name) FILTER (typ = 108) AS nlt, max(name) FILTER (typ = 109) AS dzi,
 arg_min(zip_code, d) FILTER (zip_code IS NOT NULL) AS zip, arg_min(lat, d) FILTER (lat IS NOT NULL) AS lat, arg_min(long, d) FILTER (long IS NOT NULL) AS long FROM up GROUP BY own),
addr AS (SELECT g.code, g.typ, concat_ws(chr(10), nullif(concat_ws(' ', iel, nlt) || coalesce(' - ' || dzi, ''), ''), cie, pil, pag, nov) AS address, is_leaf, zip, n.lat, n.long, depth FROM gaz g JOIN names n USING (code) JOIN leaf USING (code))"""
_WITH = f"WITH RECURSIVE {_GAZ}"


def _paths(spark, sf_dir) -> DataFrame:
    return g.with_paths(g.with_leaf_flag(g.synthetic(spark, sf_dir)))


@query("hierarchy_path", f"{_WITH} SELECT own AS code, CAST(max(d) AS INTEGER) AS depth, string_agg(CAST(code AS VARCHAR), '>' ORDER BY d) AS codes, string_agg(name, ' ' ORDER BY d DESC) AS full_name FROM up GROUP BY own")
def hierarchy_path(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("code", F.size("path").alias("depth"), F.array_join(F.transform("path", lambda o: o["code"].cast("string")), ">").alias("codes"), g.full_name(F.col("path")).alias("full_name"))


@query("leaf_flag", f"{_WITH} SELECT code, is_leaf FROM leaf")
def leaf_flag(spark, sf_dir):
    return g.with_leaf_flag(g.synthetic(spark, sf_dir)).select("code", "is_leaf")


@query(
    "index_order",
    f"""{_WITH}, f AS (SELECT own AS code, string_agg(name, ' ' ORDER BY d DESC) AS text, max(d) AS depth, arg_min(typ, d) AS typ FROM up GROUP BY own)
SELECT row_number() OVER (ORDER BY (CASE typ WHEN 113 THEN 1 WHEN 104 THEN 2 WHEN 105 THEN 3 WHEN 106 THEN 4 WHEN 107 THEN 5 WHEN 108 THEN 6 ELSE 7 END) * 100 + depth, length({_FOLD.format('text')}), {_FOLD.format('text')}, code) - 1 AS idx, code, text FROM f""",
)
def index_order(spark, sf_dir):
    return g.index_strings(g.with_paths(g.synthetic(spark, sf_dir)))


@query("address_format", f"{_WITH} SELECT code, address FROM addr")
def address_format(spark, sf_dir):
    return g.address(_paths(spark, sf_dir), ()).select("code", "address")


@query("inherited_fields", f'{_WITH} SELECT code, zip AS "zipCode", CAST(lat AS DOUBLE) AS "lksLat", CAST(long AS DOUBLE) AS "lksLong", is_leaf AS "irAdrese" FROM addr')
def inherited_fields(spark, sf_dir):
    return g.address(_paths(spark, sf_dir), ("lks_koord",)).select("code", "zipCode", F.col("lksLat").cast("double"), F.col("lksLong").cast("double"), "irAdrese")


_FIELDS = ", ".join(f"CAST(max(code) FILTER (typ = {t}) AS VARCHAR) AS \"{s}Code\", max(name) FILTER (typ = {t}) AS \"{s}Name\"" for t, s in g.SHORT.items())
_ATVK = ", ".join(f"max(atvk) FILTER (typ = {t}) AS \"{g.SHORT[t]}Atvk\"" for t in (g.PIL, g.NOV, g.PAG))


@query("address_struct", f"{_WITH} SELECT own AS code, {_FIELDS}, {_ATVK} FROM up GROUP BY own")
def address_struct(spark, sf_dir):
    out = g.address(_paths(spark, sf_dir), ("struct", "atvk"))
    codes = {f"{s}Code": F.col(f"{s}Code").cast("string") for s in g.SHORT.values()}
    return out.drop("typ", "address", "irAdrese", "zipCode").withColumns(codes)


@query("type_filter", f"{_WITH} SELECT code, typ, address FROM addr WHERE typ IN (106, 108)")
def type_filter(spark, sf_dir):
    return g.address(filters.of_types(_paths(spark, sf_dir), [g.CIE, g.NLT]), ()).select("code", "typ", "address")


@query("post_filter", f"{_WITH} SELECT code, typ, address FROM addr WHERE is_leaf AND typ IN (108, 109)")
def post_filter(spark, sf_dir):
    return g.address(filters.postal_objects(_paths(spark, sf_dir)), ()).select("code", "typ", "address")


@query("big_filter", f"{_WITH} SELECT code, typ, address FROM addr WHERE typ IN (104, 113, 105, 106)")
def big_filter(spark, sf_dir):
    return g.address(filters.of_types(_paths(spark, sf_dir), list(g.BIG)), ()).select("code", "typ", "address")


@query("code_lookup", f"{_WITH} SELECT o_orderkey, addr.code, address FROM orders JOIN addr ON addr.code = 108000000 + o_custkey")
def code_lookup(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select("o_orderkey", (F.lit(108_000_000) + F.col("o_custkey")).alias("code"))
    return asked.join(g.address(_paths(spark, sf_dir), ()).select("code", "address"), "code").select("o_orderkey", "code", "address")


@query(
    "query_dispatch",
    """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(108000000 + c_custkey AS VARCHAR) ELSE c_name END AS q, CASE WHEN c_mktsegment < 'C' THEN NULL ELSE CAST(c_acctbal * 100 AS DECIMAL(10,3)) END AS lat, CAST(c_acctbal * 100 + 200000 AS DECIMAL(10,3)) AS long FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(q, '[0-9]{9}') THEN 'code' WHEN lat IS NULL THEN 'text' WHEN lat BETWEEN 160000 AND 450000 AND long BETWEEN 300000 AND 770000 THEN 'nearest' ELSE 'none' END AS route FROM q""",
)
def query_dispatch(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    asked = F.when(F.col("c_custkey") % 3 == 0, (F.lit(108_000_000) + F.col("c_custkey")).cast("string")).otherwise(F.col("c_name"))
    lat = F.when(F.col("c_mktsegment") < "C", F.lit(None)).otherwise((F.col("c_acctbal") * 100).cast("decimal(10,3)"))
    return c.select("c_custkey", filters.route(asked, lat, (F.col("c_acctbal") * 100 + 200_000).cast("decimal(10,3)")).alias("route"))


def _near(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    point = lambda base, c: (F.lit(base) + F.col(c)).cast("decimal(10,3)")
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), point(300_000, "c_acctbal").alias("lat"), (F.lit(500_000) + F.col("c_nationkey") * 100).cast("decimal(10,3)").alias("long"))
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("q_id"), point(300_000, "s_acctbal").alias("lat"), (F.lit(500_000) + F.col("s_nationkey") * 90).cast("decimal(10,3)").alias("long"))
    return points, asked


_POINTS = """WITH p AS (SELECT c_custkey AS code, CAST(300000 + c_acctbal AS DECIMAL(10,3)) AS lat, CAST(500000 + c_nationkey * 100 AS DECIMAL(10,3)) AS long FROM customer),
q AS (SELECT s_suppkey AS q_id, CAST(300000 + s_acctbal AS DECIMAL(10,3)) AS lat, CAST(500000 + s_nationkey * 90 AS DECIMAL(10,3)) AS long FROM supplier),
d AS (SELECT q_id, code, CAST((p.lat - q.lat) * (p.lat - q.lat) + (p.long - q.long) * (p.long - q.long) AS DECIMAL(30,6)) AS distance FROM q CROSS JOIN p)"""


@query("nearest_k", f"{_POINTS} SELECT q_id, CAST(place AS INTEGER) AS place, code, CAST(distance AS DOUBLE) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, code) AS place FROM d) WHERE place <= 5")
def nearest_k(spark, sf_dir):
    return spatial.nearest(*_near(spark, sf_dir), 5).withColumn("distance", F.col("distance").cast("double"))


@query("nearest_unique", f"{_POINTS}, u AS (SELECT q_id, distance, min(code) AS code FROM d GROUP BY ALL) SELECT q_id, CAST(place AS INTEGER) AS place, code, CAST(distance AS DOUBLE) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance) AS place FROM u) WHERE place <= 5")
def nearest_unique(spark, sf_dir):
    return spatial.nearest(*_near(spark, sf_dir), 5, unique_distance=True).withColumn("distance", F.col("distance").cast("double"))


@query("bounding_box", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(10,3)) BETWEEN 160000 AND 450000 AND CAST(o_totalprice * 2 AS DECIMAL(10,3)) BETWEEN 300000 AND 770000 AS inside FROM orders")
def bounding_box(spark, sf_dir):
    at = lambda x: x.cast("decimal(10,3)")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.bounding_box(at(F.col("o_totalprice")), at(F.col("o_totalprice") * 2)).alias("inside"))


@query("resolve_batch")
def resolve_batch(spark, sf_dir):
    objects = Scratch(spark, "objects").keep(g.with_paths(g.synthetic(spark, sf_dir)).select("code", "typ", g.named_path(F.col("path")).alias("path")))
    asked = objects.select(F.col("code").alias("q_id"), F.replace(g.format_address(F.col("path")), F.lit("\n"), F.lit(", ")).alias("text"))
    return resolve.resolve_alike(asked, resolve.Alike.build(objects))


@query(
    "history_collect",
    "SELECT 108000000 + o_custkey AS code, CAST(count(*) AS INTEGER) AS n, string_agg(o_orderpriority, '|' ORDER BY o_orderkey DESC) AS history FROM orders GROUP BY o_custkey",
)
def history_collect(spark, sf_dir):
    own = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("o_orderkey")).alias("k"), "o_orderpriority"))).alias("h"))
    return own.select((F.lit(108_000_000) + F.col("o_custkey")).alias("code"), F.size("h").alias("n"), F.array_join("h.o_orderpriority", "|").alias("history"))


@query("database_history", "SELECT o_custkey AS code, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS INTEGER) AS pos, o_orderpriority AS text FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)")
def database_history(spark, sf_dir):
    from waymark.sources import opendata

    return opendata.database_history(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("adr_cd"), F.col("o_orderpriority").alias("std")))


# ---- synchronisation ---------------------------------------------------------------------------


def _copies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An older copy of orders, with other prices, and orders."""
    source = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    target = source.where("o_orderdate < timestamp '1996-01-01'").withColumn("o_totalprice", F.lit(0.0))
    return target, source


@query(
    "sync_incremental",
    """WITH t AS (SELECT o_orderkey, 0.0::DOUBLE AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), f AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM t) OR NOT EXISTS (SELECT 1 FROM t))
SELECT o_orderkey, o_totalprice FROM t ANTI JOIN f USING (o_orderkey) UNION ALL SELECT o_orderkey, o_totalprice FROM f""",
)
def sync_incremental(spark, sf_dir):
    return sync.incremental(*_copies(spark, sf_dir), "o_orderkey", "o_orderdate").select("o_orderkey", "o_totalprice")


@query("sync_id_diff", "SELECT coalesce(o, c) AS key, CASE WHEN o IS NULL THEN 'insert' ELSE 'delete' END AS action FROM (SELECT DISTINCT o_custkey AS o FROM orders) FULL JOIN (SELECT c_custkey AS c FROM customer WHERE c_acctbal > 0) ON o = c WHERE o IS NULL OR c IS NULL")
def sync_id_diff(spark, sf_dir):
    target = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return sync.id_diff(target, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


@query("sync_apply_diff", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def sync_apply_diff(spark, sf_dir):
    return sync.apply_diff(*_copies(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("sync_full", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sync_full(spark, sf_dir):
    source = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return sync.migrate(source.limit(0), source, "s_suppkey")


@query("tz_convert", "SELECT event_id, strftime(timezone('UTC', timezone('Europe/Riga', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def tz_convert(spark, sf_dir):
    own = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(text.riga_to_utc(own), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# ---- output and refresh ------------------------------------------------------------------------


@query("csv_dump", f"{_WITH} SELECT concat_ws(';', code, regexp_replace(address, '[\\n|;]', ', ', 'g'), typ, coalesce(zip, 'null'), coalesce(CAST(lat AS VARCHAR), 'null'), coalesce(CAST(long AS VARCHAR), 'null')) AS value FROM addr")
def csv_dump(spark, sf_dir):
    return sinks.csv_lines(g.address(_paths(spark, sf_dir), ("lks_koord",)))


@query("json_result", f"""{_WITH} SELECT code, '{{"code":' || code || ',"typ":' || typ || ',"address":"' || replace(address, chr(10), ', ') || '","irAdrese":' || is_leaf || coalesce(',"zipCode":"' || zip || '"', '') || '}}' AS json FROM addr""")
def json_result(spark, sf_dir):
    return g.address(_paths(spark, sf_dir), ()).select("code", sinks.json_result(["code", "typ", "address", "irAdrese", "zipCode"]).alias("json"))


@query("latest_version", "SELECT event_type, strftime(max(ts), '%Y_%m_%dT%H_%M_%S') AS version FROM events GROUP BY event_type")
def latest_version(spark, sf_dir):
    name = F.concat(F.date_format("ts", "yyyy_MM_dd'T'HH_mm_ss"), F.lit(".events.csv"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max(text.version_of(name)).alias("version"))


@query("refresh_stream", "SELECT event_type, max(ts) AS latest, count(*) AS n_events FROM events GROUP BY event_type")
def refresh_stream(spark, sf_dir):
    name = f"refresh_{uuid.uuid4().hex[:8]}"
    return refresh.latest_by_type(spark, f"{sf_dir}/event[s].parquet", read(spark, sf_dir, "events").schema, name, f"{shared_dir(spark)}/{name}")
