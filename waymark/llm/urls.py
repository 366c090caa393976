"""URL filters: rules first, then a character language-model ratio; DataFrame operations only.

Two variable-order Markov models, of accepted and of rejected URLs, give each
character its probability after up to ``ORDER - 1`` characters before it.  A
context is a state if it was seen ``min_context`` times, else a shorter one
serves; Witten-Bell smoothing mixes each order with the next lower one.  A URL's
score is the mean over its characters of log P(accepted) - log P(rejected), held
as millionths in integers, so sums do not depend on their order.  The threshold
is calibrated on URLs that the models have not seen: the gap between bins that best parts
the two classes, each with weight one.

URLs decided by a rule are the examples: those whose text has a digest that begins with 0 to 3, a
quarter of all texts, calibrate, and the others train.

Defined results: a null url or one without "://" has empty host and path and scores
as an empty text, and is allowed where no rule blocks it; URLs of any length are scored whole, by the mean over their
characters; a score equal to the threshold is allowed, and of thresholds that part equally well the highest counts; repeated rows are judged
alike, each on its own; with no calibrating URL of a class the threshold is 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.decontam import LOWER, UPPER

ORDER = 4
PAD = "^" * (ORDER - 1)
#: What the models see: a-z, one symbol for all digits, these marks, and one symbol for all else.
MARKS = "./-_?=&#%"
#: Grams are ORDER of the letters, one digit, the marks, one symbol for all else and the pad, so there are no more than this at any input's size, and they are broadcast.
MOST_GRAMS = (26 + 1 + len(MARKS) + 2) ** ORDER
MILLION = 1_000_000
BIN = 10_000
PIECE = 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule; rules are (action, host/path) in any order."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def symbols(url: Column) -> Column:
    """The part after the scheme in the models' alphabet."""
    text = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    return F.regexp_replace(text, r"[^a-z0./\-_?=&#%]", "~")


def held_out(s: Column) -> Column:
    """Whether a text calibrates the threshold."""
    return F.substring(F.md5(s.cast("binary")), 1, 1).isin("0", "1", "2", "3")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``s`` with the ORDER - 1 before it.

    Texts fall into pieces first, so a row never carries more than one.
    """
    p = F.concat(F.lit(PAD), "s")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("s") - 1) / PIECE).cast("int")), lambda k: F.substr(p, k * PIECE + 1, F.lit(PIECE + ORDER - 1)))
    cut = rows.where("s <> ''").select(*keep, F.explode(pieces).alias("piece"))
    at = F.explode(F.sequence(F.lit(1), F.length("piece") - (ORDER - 1)))
    return cut.select(*keep, "piece", at.alias("i")).select(*keep, F.substr("piece", F.col("i"), F.lit(ORDER)).alias("gram"))


def _key(s: Column) -> Column:
    """A text's digest, which its characters carry in place of the text."""
    return F.unhex(F.md5(s.cast("binary")))


def gram_scores(train: DataFrame, grams: DataFrame, min_context: int) -> DataFrame:
    """gram, diff: millionths of log P(accepted) - log P(rejected) of a gram's last character.

    train: action, s.  Counts per gram come first, so all that follows is as
    small as the alphabet lets it be.
    """
    top = _grams(train, "action").groupBy("gram").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("r"))
    out = grams.select("gram", F.lit(1.0 / 39).alias("pa"), F.lit(1.0 / 39).alias("pr"))
    for k in range(1, ORDER + 1):  # k symbols with the predicted one
        own = top.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        context = own.groupBy(F.substring("g", 1, k - 1).alias("h")).agg(F.sum("ca").alias("na"), F.sum("cr").alias("nr"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cr") > 0).alias("tr"))
        out = out.withColumn("g", F.substring("gram", ORDER - k + 1, k)).join(own, "g", "left").withColumn("h", F.substring("g", 1, k - 1)).join(context, "h", "left")

        def mixed(p: str, c: str, n: str, t: str) -> Column:
            is_state = F.coalesce(F.col(n), F.lit(0)) >= (min_context if k > 1 else 1)
            return F.when(is_state, (F.coalesce(F.col(c), F.lit(0)) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))

        out = out.select("gram", mixed("pa", "ca", "na", "ta").alias("pa"), mixed("pr", "cr", "nr", "tr").alias("pr"))
    return out.select("gram", F.round((F.log("pa") - F.log("pr")) * MILLION).cast("bigint").alias("diff"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], min_context: int = 3) -> DataFrame:
    """page_id, host, path, rule, action, score (millionths, mean over characters) and verdict of every URL."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), symbols(url).alias("s"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    texts = rows.groupBy("s", "action").agg(F.count("*").alias("times"))  # each text is scored once
    scored = gram_scores(rows.where(F.col("action").isNotNull() & ~held_out(F.col("s"))).select("action", "s"), _grams(rows).groupBy("gram").count().select("gram"), min_context)
    side = F.broadcast(scored)  # MOST_GRAMS rows at most, some 2 million short ones
    # Characters of a text stay in one task up to the sum, so the shuffle after it has a row for each text.
    sums = _grams(texts.select("s", _key(F.col("s")).alias("k")).distinct(), "k").join(side, "gram").groupBy("k").agg(F.floor(F.sum("diff") / F.count("*")).alias("score"))
    classes = texts.withColumn("k", _key(F.col("s"))).join(sums, "k", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("bigint")))
    bins = classes.where(F.col("action").isNotNull() & held_out(F.col("s"))).groupBy(F.floor(F.greatest(F.least(F.col("score"), F.lit(20 * MILLION)), F.lit(-20 * MILLION)) / BIN).alias("bin")).agg(
        F.sum(F.when(F.col("action") == "allow", F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(F.col("action") == "block", F.col("times")).otherwise(0)).alias("r")
    )  # at most 40 * MILLION / BIN + 1 rows
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_of = lambda c: F.nullif(F.sum(c).over(every), F.lit(0))
    right = F.coalesce(F.sum("r").over(below), F.lit(0)) / all_of("r") + 1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / all_of("a")
    gap = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin"))  # the threshold is halfway from the bin below
    best = bins.withColumn("right", F.round(right, 9)).withColumn("below", gap).where("right is not null").agg(F.max(F.struct("right", "bin", "below")).alias("b")).first()["b"]
    threshold = (best["bin"] + best["below"] + 1) * BIN // 2 if best else 0
    out = rows.withColumn("k", _key(F.col("s"))).join(sums, "k", "left")
    by_score = F.when((F.col("s") == "") | (F.coalesce("score", F.lit(0)) >= threshold), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", "action", "score", F.coalesce("action", by_score).alias("verdict"))


def sql(rules: list[tuple[str, str]], min_context: int = 3) -> str:
    """The whole of judge_urls for DuckDB."""
    ordered = sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    fits = {rule: f"((host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}'))" for _, rule in ordered}
    name = " ".join(f"WHEN {fits[rule]} THEN '{rule}'" for _, rule in ordered)
    action = " ".join(f"WHEN {fits[rule]} THEN '{act}'" for act, rule in ordered)
    steps, p = [], "SELECT gram, 1.0::DOUBLE / 39 AS pa, 1.0::DOUBLE / 39 AS pr FROM (SELECT DISTINCT gram FROM grams)"
    for k in range(1, ORDER + 1):
        least = min_context if k > 1 else 1
        mixed = lambda p, c, n, t: f"CASE WHEN coalesce({n}, 0) >= {least} THEN (coalesce({c}, 0) + {t} * {p}) / ({n} + {t}) ELSE {p} END"  # noqa: B023, E731
        steps.append(f"o{k} AS (SELECT substring(gram, {ORDER - k + 1}, {k}) AS g, sum(a) AS ca, sum(r) AS cr FROM top GROUP BY 1)")
        steps.append(f"h{k} AS (SELECT substring(g, 1, {k - 1}) AS h, CAST(sum(ca) AS DOUBLE) AS na, CAST(sum(cr) AS DOUBLE) AS nr, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cr > 0) AS tr FROM o{k} GROUP BY 1)")
        steps.append(f"p{k} AS (SELECT b.gram, {mixed('pa', 'ca', 'na', 'ta')} AS pa, {mixed('pr', 'cr', 'nr', 'tr')} AS pr FROM ({p}) b LEFT JOIN o{k} ON o{k}.g = substring(b.gram, {ORDER - k + 1}, {k}) LEFT JOIN h{k} ON h{k}.h = substring(b.gram, {ORDER - k + 1}, {k - 1}))")
        p = f"SELECT * FROM p{k}"
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
 regexp_replace(translate(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), ''), '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./\-_?=&#%]', '~', 'g') AS s FROM pages),
r AS (SELECT *, CASE {name} END AS rule, CASE {action} END AS action FROM u),
texts AS (SELECT s, action, count(*) AS times FROM r GROUP BY ALL),
grams AS (SELECT s, substring('{PAD}' || s, i, {ORDER}) AS gram FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT DISTINCT s FROM texts WHERE s <> ''))),
top AS (SELECT gram, sum(times) FILTER (action = 'allow') AS a, sum(times) FILTER (action = 'block') AS r FROM grams JOIN texts USING (s) WHERE action IS NOT NULL AND md5(s)[1] NOT IN ('0', '1', '2', '3') GROUP BY gram),
{', '.join(steps).replace('sum(a)', 'sum(coalesce(a, 0))').replace('sum(r)', 'sum(coalesce(r, 0))')},
diff AS (SELECT gram, CAST(round((ln(pa) - ln(pr)) * {MILLION}) AS BIGINT) AS diff FROM p{ORDER}),
score AS (SELECT s, CAST(floor(sum(diff) / count(*)) AS BIGINT) AS score FROM grams JOIN diff USING (gram) GROUP BY s),
bins AS (SELECT CAST(floor(greatest(least(coalesce(score, 0), {20 * MILLION}), {-20 * MILLION}) / {BIN}) AS BIGINT) AS bin, sum(times) FILTER (action = 'allow') AS a, sum(times) FILTER (action = 'block') AS r FROM texts LEFT JOIN score USING (s) WHERE action IS NOT NULL AND md5(s)[1] IN ('0', '1', '2', '3') GROUP BY 1),
cut AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin) AS below, round(coalesce(sum(coalesce(r, 0)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT nullif(sum(r), 0) FROM bins) + 1 - coalesce(sum(coalesce(a, 0)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT nullif(sum(a), 0) FROM bins), 9) AS fit FROM bins),
t AS (SELECT coalesce((SELECT (bin + below + 1) * {BIN // 2} FROM cut WHERE fit IS NOT NULL ORDER BY fit DESC, bin DESC LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN r.s = '' OR coalesce(score, 0) >= (SELECT threshold FROM t) THEN 'allow' ELSE 'block' END) AS verdict FROM r LEFT JOIN score USING (s)
"""
