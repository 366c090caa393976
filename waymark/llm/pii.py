"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed kinds (email, ip, card, phone) are the seed entities.  Tokens shaped like a
credential (``CREDENTIAL``) are weak seeds: they count half, and are found only where a pattern
confirms them.  Every other identifier-like token (three digits or more, or an @) that no seed
covers is a candidate.

What stands beside a seed or candidate induces lexical patterns: its side, the one, two or three
pieces next to it (runs of letters and digits, or of other marks, such as ``token``, ``=``, ``"``), and
the instance's shape.  Patterns and instances make a graph that Spark scores in rounds:

    pattern  = summed scores of the different instances beside it / (that sum + different
               contexts of its pieces in prose)
    instance = 1 - (1 - best pattern on its left) * (1 - best on its right), over confident
               patterns; a seed is 1, a weak seed 0.5 at least

A pattern is confident from ``confident`` on if ``support`` different instances of that score or
more carry it.  A context in prose is the two pieces on the pattern's other side where the
adjacent token has neither a digit nor an @.  Candidates without a score count neither for nor
against, and copies count once, so no group of copies switches a pattern off; common words have
more contexts than instances and never become patterns.  After the rounds, candidates that
patterns give ``confident`` or more are further spans of kind "id".

Only the seeds, candidates and hashes of their neighbours leave the texts. Contexts are counted for
pieces with ``support`` instances or more, in one pass, and in each task only up to the number that
decides against them: ``most_broadcast`` pieces are listed to the tasks, all others pass through a filter of bounded
size. Patterns beside very many instances, and instances beside very many patterns, are joined apart.

Defined results: null and empty texts have no spans; repeated rows are extracted each; spans
of equal texts are equal; whole texts are read, however long, in linear time; an instance that
scores exactly ``confident`` counts as found; null doc_ids stay; an empty table gives no rows; other
columns are ignored, also where their names clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import _text
from waymark.llm._store import Scratch, join_split

KINDS = ("email", "ip", "card", "phone")
# What the kinds look like.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
# What published credential formats look like.
CREDENTIAL = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_HEX = re.compile(r"[0-9a-f]{8,}")
_NUMBER = re.compile(r"[0-9+(). -]+")
_TRIM = ".,;:!?()[]{}<>\"'"
PIECES = 3
BLOCK_BYTES = 1 << 20
FOUND = "row string, what string, doc_id bigint, base string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, first bigint, last bigint, token binary, shape string, prior double, left array<bigint>, right array<bigint>"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
_COLUMNS = [x.split() for x in FOUND.split(", ")]
#: Kinds of byte: 0 space, 1 letters, digits and non-ASCII, 2 other marks.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[list(_text.SPACE_BYTES)] = 0
DIGIT = np.zeros(256, np.int64)
DIGIT[[*range(48, 58), 64]] = 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Linear: each @ has one possible start, after the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each fixed kind, in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _kind(c: str) -> int:
    return int(KIND[ord(c)]) if c.isascii() else 1


def _beside(text: str, at: int, step: int) -> list[str]:
    """The PIECES pieces before (step -1) or from (step 1) a place, nearest first, A-Z lower-cased."""
    out: list[str] = []
    i = at if step > 0 else at - 1
    while 0 <= i < len(text) and len(out) < PIECES:
        kind, first = _kind(text[i]), i
        while 0 <= i < len(text) and _kind(text[i]) == kind:
            i += step
        if kind:
            own = text[first:i] if step > 0 else text[i + 1 : first + 1]
            out.append("".join(c.lower() if c.isascii() else c for c in own))
    return out


def _chain(pieces: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of one, two, ... pieces, nearest first."""
    h = np.full(len(pieces[0]), 0x243F6A8885A308D3, np.uint64)
    for piece in pieces:
        with np.errstate(over="ignore"):
            h = _text.mix(h * np.uint64(0x9FB21C651E98DF25) + piece)
        yield h


def _context_hashes(near: list[list[str]]) -> list[list[int]]:
    """For each row of pieces, the hash of its first, first two, first three."""
    flat = [p.encode() for row in near for p in row]
    if not flat:
        return [[] for _ in near]
    ends = np.cumsum([len(p) for p in flat], dtype=np.int64)
    own = _text.span_hashes(np.frombuffer(b"".join(flat), np.uint8), ends - [len(p) for p in flat], ends)
    counts = np.array([len(row) for row in near])
    at = np.cumsum(counts) - counts
    columns = [own[np.minimum(at + j, len(own) - 1)] for j in range(PIECES)]
    hashes = [h.view(np.int64) for h in _chain(columns)]
    return [[int(h[i]) for h in hashes[: counts[i]]] for i in range(len(near))]


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    taken = sorted(taken)
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))
    for m in _TOKEN.finditer(text):
        token = m[0]
        first = m.start() + len(token) - len(token.lstrip(_TRIM))
        last = m.end() - (len(token) - len(token.rstrip(_TRIM)))
        before = bisect.bisect_left(starts, last)
        if first < last and ("@" in text[first:last] or len(_DIGIT.findall(text, first, last)) >= 3) and not (before and reach[before - 1] > first):
            yield first, last


def shape(token: str) -> str:
    return "email" if "@" in token else "number" if _NUMBER.fullmatch(token) else "hex" if _HEX.fullmatch(token.lower()) else "mixed"


def _scan(docs: DataFrame) -> DataFrame:
    """Rows what = doc (base spans), seed or candidate (with the hashes of what stands beside it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in _text.blocks(batch.column(1), BLOCK_BYTES):
                rows: list[dict] = []
                near: list[list[str]] = []
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    text = text or ""
                    spans = find_spans(text)
                    row = f"{part}-{serial}"
                    serial += 1
                    rows.append({"row": row, "what": "doc", "doc_id": doc_id, "base": ",".join(f"{k}:{x}:{y}" for k in KINDS for x, y in spans[k])} | {f"n_{k}": len(spans[k]) for k in KINDS})
                    taken = [s for k in KINDS for s in spans[k]]
                    for what, own in (("seed", taken), ("candidate", _candidates(text, taken))):
                        for x, y in own:
                            token = text[x:y]
                            prior = 1.0 if what == "seed" else 0.5 if CREDENTIAL.fullmatch(token) else 0.0
                            rows.append({"row": row, "what": what, "first": x, "last": y, "token": hashlib.md5(token.lower().encode()).digest(), "shape": shape(token), "prior": prior})
                            near += [_beside(text, x, -1), _beside(text, y, 1)]
                hashes = iter(_context_hashes(near))
                for r in rows:
                    if r["what"] != "doc":
                        r["left"], r["right"] = next(hashes), next(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[k]) for c, k in _COLUMNS], names=[c for c, _ in _COLUMNS])

    return docs.mapInArrow(run, FOUND)


SIDES = ("left", "right")
PATTERN = ["side", "context", "shape"]


class Pieces:
    """Pieces of a block of texts: hashes, the text of each, and whether its token has a digit or an @."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        kind = KIND[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        new = np.ones(n + 1, bool)
        new[1:n] = kind[1:] != kind[:-1]
        new |= edge
        cuts = np.flatnonzero(new)
        starts, ends = cuts[:-1], cuts[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        self.hashes = _text.span_hashes(_text.LOWER[data], starts, ends)
        self.owner = np.searchsorted(offsets, starts, side="right") - 1
        tokens = _text.Words(data, offsets)
        sums = np.concatenate([[0], np.cumsum(DIGIT[data])])
        marked = sums[tokens.ends] > sums[tokens.starts]
        self.marked = marked[np.searchsorted(tokens.starts, starts, side="right") - 1]

    def at(self, i: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it is in the same text) of the piece ``by`` further."""
        j = i + by
        inside = (j >= 0) & (j < len(self.hashes))
        j = np.where(inside, j, 0)
        return j, inside & (self.owner[j] == self.owner[i])


def _among(values: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands among ascending ones, and whether it is one of them."""
    at = np.minimum(np.searchsorted(ascending, values), max(len(ascending) - 1, 0))
    return at, ascending[at] == values if len(ascending) else np.zeros(len(values), bool)


class _Seen:
    """A growing set of hashes, as ascending runs of which each is more than twice the next, so adding stays near linear."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def new(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for run in self.runs:
            out &= ~_among(values, run)[1]
        return out

    def add(self, values: np.ndarray) -> None:
        """Ascending values that are all new."""
        if len(values):
            self.runs.append(values)
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]))]


def _in_filter(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in its word of the filter."""
    own = words[(hashes >> np.uint64(65 - len(words).bit_length())).astype(np.int64)]
    bits = np.uint64(1) << (hashes & np.uint64(63)) | np.uint64(1) << (hashes >> np.uint64(6) & np.uint64(63))
    return own & bits == bits


@dataclass
class Asked:
    """What a task knows of one side's asked contexts: the listed ones, ascending, with the number that decides against
    each; a filter of all others, if there are some, and a number that decides against any of them."""

    keys: np.ndarray
    most: np.ndarray
    rest: np.ndarray | None
    rest_most: int


class _Counter:
    """Different prose contexts of the asked pieces of one side, up to the number that decides.

    Unlisted pieces are counted for the last ``room`` of them at most; a count that is forgotten begins
    anew, which sends more than is needed and leaves out nothing.
    """

    def __init__(self, asked: Asked, step: int, room: int = 1 << 20):
        self.asked, self.step, self.room = asked, step, room
        self.counts, self.seen = np.zeros(len(asked.keys), np.int64), _Seen()
        self.rest_keys, self.rest_counts, self.rest_seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), _Seen()

    @staticmethod
    def _take(context: np.ndarray, group: np.ndarray, counts: np.ndarray, most: np.ndarray | int, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
        """(context, group) not seen before, each group up to ``most``; group numbers ``counts``, which grows with ``seen``."""
        context, index = np.unique(context, return_index=True)
        new = seen.new(context)
        context, group = context[new], group[index][new]
        order = np.argsort(group, kind="stable")
        context, group = context[order], group[order]
        fits = np.arange(len(group)) - np.searchsorted(group, group) < (most - counts)[group]
        context, group = context[fits], group[fits]
        counts += np.bincount(group, minlength=len(counts))
        seen.add(np.sort(context))
        return context, group

    def add(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(context, prose context) hashes not seen before."""
        got_keys, got = [], []
        every = np.arange(len(pieces.hashes))
        columns, valid = [], np.ones(len(every), bool)
        two = [pieces.at(every, -self.step * (d + 1)) for d in range(2)]
        first, second = (np.where(inside, pieces.hashes[j], np.uint64(0)) for j, inside in two)
        prose = ~(two[0][1] & pieces.marked[two[0][0]])
        for n in range(PIECES):
            j, inside = pieces.at(every, self.step * n)
            valid = valid & inside
            columns.append(pieces.hashes[j])
            *_, chain = _chain(columns)
            contexts = lambda i, chain=chain: list(_chain([chain[i], first[i], second[i]]))[-1]
            at, hit = _among(chain, self.asked.keys)
            i = np.flatnonzero(hit & valid & prose)
            i = i[self.counts[at[i]] < self.asked.most[at[i]]]
            context, group = self._take(contexts(i), at[i], self.counts, self.asked.most, self.seen)
            got_keys.append(self.asked.keys[group])
            got.append(context)
            if self.asked.rest is not None:
                i = np.flatnonzero(valid & prose & ~hit)
                i = i[_in_filter(chain[i], self.asked.rest)]
                keys = np.union1d(self.rest_keys, chain[i])
                counts = np.zeros(len(keys), np.int64)
                counts[np.searchsorted(keys, self.rest_keys)] = self.rest_counts
                context, group = self._take(contexts(i), np.searchsorted(keys, chain[i]), counts, self.asked.rest_most, self.rest_seen)
                got_keys.append(keys[group])
                got.append(context)
                self.rest_keys, self.rest_counts = keys, counts
                if len(keys) > self.room:
                    self.rest_keys, self.rest_counts, self.rest_seen = keys[:0], counts[:0], _Seen()
        return np.concatenate(got_keys), np.concatenate(got)


def _filter_words(rest: DataFrame, n: int) -> dict[str, np.ndarray]:
    """A filter of the contexts (side, context, k) of each side: two bits of one 64-bit word for each, about four contexts a word up to 2^21 words."""
    bits = max(6, min(21, (n // 4).bit_length()))
    mask = F.expr("shiftleft(1L, CAST(context & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(context, 6) & 63 AS INT))")
    words = rest.groupBy("side", F.shiftrightunsigned("context", 64 - bits).alias("at")).agg(F.bit_or(mask).alias("word")).toArrow()  # 2^21 rows a side at most
    out = {}
    for side in SIDES:
        own = words.filter(pyarrow.compute.equal(words["side"], side))
        out[side] = np.zeros(1 << bits, np.uint64)
        out[side][own["at"].to_numpy()] = own["word"].to_numpy().view(np.uint64)
    return out


def _prose(docs: DataFrame, asked: DataFrame, confident: float, most_broadcast: int, scratch: Scratch) -> DataFrame:
    """side, context, prose: different contexts in prose of the asked (side, context, k), in one pass over the texts.

    With k instances at most, a pattern fails once it has more than k * (1 - confident) / confident
    contexts, so each task stops at one more than that.  Up to ``most_broadcast`` contexts, those with the most
    instances, are listed to the tasks; the rest pass through a filter, and what it lets through wrongly has no row in asked.
    """
    asked = scratch.table(asked, "asked")
    size = F.length(F.bin("k"))
    bar, listed, n = 1, 0, asked.count()
    if n > most_broadcast:
        bar = 1 << 62
        for r in sorted(asked.groupBy(size.alias("bits")).count().collect(), reverse=True):  # 63 rows at most
            if listed + r["count"] > most_broadcast:
                break
            bar, listed = 1 << (r["bits"] - 1), listed + r["count"]
    decides = lambda k: np.floor(k * (1 - confident) / confident).astype(np.int64) + 1
    own, rest, rest_most = asked.where(F.col("k") >= bar).toArrow(), None, 0
    if bar > 1:
        others = asked.where(F.col("k") < bar)
        rest, rest_most = _filter_words(others, n - listed), int(decides(np.float64(others.agg(F.max("k")).first()[0])))
    known = []
    for side in SIDES:
        mine = own.filter(pyarrow.compute.equal(own["side"], side))
        keys = mine["context"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        known.append(Asked(keys[order], decides(mine["k"].to_numpy()[order]), rest and rest[side], rest_most))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # two numbers for each of most_broadcast contexts, and the filter's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counter(own, step) for own, step in zip(shared.value, (-1, 1), strict=True)]
        for batch in batches:
            for a, b in _text.blocks(batch.column(0), BLOCK_BYTES):
                pieces = Pieces(*_text.text_bytes(batch.column(0).slice(a, b - a)))
                for side, counter in zip(SIDES, counters, strict=True):
                    keys, context = counter.add(pieces)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array([side] * len(keys)), pa.array(keys.view(np.int64)), pa.array(context.view(np.int64))], names=["side", "context", "at"])

    pairs = docs.select("text").mapInArrow(run, "side string, context bigint, at bigint").distinct()
    counts = pairs.groupBy("side", "context").agg(F.count("*").alias("prose"))
    return scratch.table(counts.join(asked.select("side", "context"), ["side", "context"], "left_semi") if rest else counts, "prose")


def scored_edges(found: DataFrame) -> DataFrame:
    """side, context, shape, token, prior: each instance beside each pattern, once."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("contexts")) for s in SIDES])
    rows = found.where("what <> 'doc'").select("shape", "token", "prior", F.explode(sides).alias("s")).select("s.side", F.explode("s.contexts").alias("context"), "shape", "token", "prior")
    return rows.groupBy(*PATTERN, "token").agg(F.max("prior").alias("prior"))


def rescore(edges: DataFrame, prose: DataFrame, total: int, confident: float, support: int, scratch: Scratch, name: str) -> DataFrame:
    """token, got: what confident patterns give to the instances beside them. edges: with score."""
    good = F.count_if(F.col("score") >= confident)
    weighed = edges.groupBy(*PATTERN).agg(F.sum("score").alias("weight"), good.alias("good"), F.count("*").alias("many")).where(F.col("good") >= support)
    pattern = F.col("weight") / (F.col("weight") + F.coalesce("prose", F.lit(0)))
    patterns = scratch.table(weighed.join(prose, ["side", "context"], "left").select(*PATTERN, "many", pattern.alias("pattern")).where(F.col("pattern") >= confident), f"{name}-patterns")
    best = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("pattern"))), F.lit(0.0))
    return join_split(edges.select(*PATTERN, "token"), patterns, PATTERN, total).groupBy("token").agg((1 - (1 - best("left")) * (1 - best("right"))).alias("got"))


def by_token(rows: DataFrame, got: DataFrame, hot: DataFrame | None, most_broadcast: int, how: str) -> DataFrame:
    """Join of rows with ``got``, unique by token, by a broadcast up to ``most_broadcast``; beyond, the ``hot`` tokens never meet in one task."""
    if got.count() <= most_broadcast:
        return rows.join(F.broadcast(got), "token", how)
    if hot is None:
        return rows.join(got, "token", how)
    hot = F.broadcast(hot)
    apart = rows.join(hot, "token", "left_semi").join(F.broadcast(got.join(hot, "token", "left_semi")), "token", how)
    return apart.unionByName(rows.join(hot, "token", "left_anti").join(got, "token", how))


def hot_tokens(rows: DataFrame, total: int, scratch: Scratch, name: str, most: int = 2000) -> DataFrame | None:
    """token of those that more than 1 / ``most`` of the ``total`` rows have, so at most ``most``; None without such."""
    hot = scratch.table(rows.groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") > max(1000, total // most)).select("token"), name)
    return hot if hot.count() else None


def discover(docs: DataFrame, found: DataFrame, scratch: Scratch, rounds: int = 3, confident: float = 0.5, support: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """token of every candidate that confident patterns give ``confident`` or more."""
    edges = scratch.table(scored_edges(found), "edges")
    total = edges.count()
    asked = edges.groupBy(*PATTERN).agg(F.count("*").alias("k")).where(F.col("k") >= support)
    prose = _prose(docs, asked.groupBy("side", "context").agg(F.max("k").alias("k")), confident, most_broadcast, scratch)
    hot = hot_tokens(edges, total, scratch, "hot-edges") if total > most_broadcast else None  # else no token can have more rows
    scored, got = edges.withColumn("score", F.col("prior")), None
    for i in range(rounds):
        got = scratch.table(rescore(scored, prose, total, confident, support, scratch, f"round{i}"), f"round{i}")
        scored = by_token(edges, got, hot, most_broadcast, "left").withColumn("score", F.greatest("prior", F.coalesce("got", F.lit(0.0)))).drop("got")
    return got.where(F.col("got") >= confident).select("token")


def extract(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end, by kind, then start), found (spans of kind id, as array of start, end)."""
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.table(_scan(rows), "found")
    most_broadcast = options.get("most_broadcast", 1_000_000)
    tokens = scratch.table(discover(rows, found, scratch, **options), "tokens")
    candidates = found.where("what = 'candidate'").select("row", "token", "first", "last")
    hot = None
    if tokens.count() > most_broadcast:
        hot = hot_tokens(candidates, candidates.count(), scratch, "hot-tokens")
    more = by_token(candidates, tokens, hot, most_broadcast, "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("found"))
    out = found.where("what = 'doc'").join(more, "row", "left")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.coalesce("found", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("found"))

