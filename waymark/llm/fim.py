"""Fill-in-the-middle transformation by one match with repeated captures.

A text is a run of units, each a run of letters A-Z, a-z or one other character.  One
``regex.fullmatch`` of ``(unit)*`` keeps every repetition of its group, so ``match.ends(1)`` is the
list of all unit ends: its length is n, and two look-ups in it are the cut offsets.  A unit is
greedy and the next one cannot begin with what it left, so the match never goes back.

The places of the cuts, the form and the share of plain texts come from a digest of the seed and
the document's id, so a document is cut alike in every run and on every executor.  Only the match
runs in Python; digests, cuts, joins and ``restore`` are column functions, and nothing is shuffled.

Memory: a match keeps about 150 bytes a unit while its text is worked on (2.8 million characters
in 1.2 million units: 180 MB), and a task holds the offsets of one text at a time.

Defined results: a null text is an empty one; an empty text has n = 0 and is plain; a text that has one of
the marks is plain, so ``restore`` is exact for every text; a null doc_id counts as the digits "";
rows of equal doc_id and text are alike, rows of equal doc_id and other text are cut by the same
digest; texts of any length are cut whole; an empty table gives no rows; other columns pass through, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_ends(text: str) -> list[int]:
    """Where each unit of a text ends, in code points."""
    return UNITS.fullmatch(text).ends(1)


def cuts(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle): after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units."""
    ends = unit_ends(text)
    n = len(ends)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def _cut_column(text: Column, h1: Column, h2: Column) -> Column:
    kind = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "first", "second")])

    @F.pandas_udf(kind)
    def cut(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in rows:
            got = [cuts(*x) for x in zip(texts, one, two, strict=True)]
            yield pd.DataFrame(got, columns=["n", "first", "second"], dtype="int64")

    return cut(text, h1, h2)


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output.

    Of 100 documents those from ``plain_from`` on stay plain; of the others those below
    ``spm_below`` begin with the suffix (spm), the rest with the prefix (psm).
    """
    whole = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    plain = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE)) | (h3 % 100 >= plain_from)
    form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    own = "_fim"
    while own in map(str.lower, kept):
        own += "_"
    cut = docs.select(*kept, F.struct(whole.alias("whole"), form.alias("form"), _cut_column(whole, h1, h2).alias("at")).alias(own))
    text, kind, a, b = F.col(f"{own}.whole"), F.col(f"{own}.form"), F.col(f"{own}.at.first"), F.col(f"{own}.at.second")
    prefix = F.substr(text, F.lit(1), a.cast("int"))
    middle = F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substr(text, (b + 1).cast("int"))
    out = F.when(kind == "plain", text).when(kind == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    of_cut = lambda x: F.when(kind != "plain", x)
    return cut.select(*kept, F.col(f"{own}.at.n").alias("n"), kind.alias("form"), of_cut(a).alias("prefix_chars"), of_cut(b - a).alias("middle_chars"), out.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: each mark of a cut text stands once, as a text with marks stays plain."""
    after = lambda mark: F.substr(output, F.position(F.lit(mark), output) + len(mark))
    before = lambda rest, mark: F.substr(rest, F.lit(1), F.position(F.lit(mark), rest) - 1)
    psm = F.concat(before(after(PREFIX), SUFFIX), after(MIDDLE), before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), after(MIDDLE), before(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
