"""LM scoring by a weighted backoff automaton.

n-gram counts of all training texts make an interpolated model:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + e(c(h)) * p(w | shorter h)) / (c(h) + e(c(h))),   e(c) = scale * c ** power

with one power and scale an order.  c ** power stands for how many different tokens follow a
context seen c times: its sum over all contexts is the number of different n-grams.  The scale
makes the mean weight of the lower order over all training tokens the Good-Turing share of
unseen n-grams (n-grams seen once / all).  Both come from histograms of the counts.
Seen n-grams are the automaton's states and arcs; a failure arc from h to its suffix
weighs e / (c(h) + e).  One left-to-right traversal carries a text's state and adds
log10 probabilities; the texts of a block advance together.

The model grows with the corpus and is never in one place.  Texts are written once as
blocks with a name.  A block sends its distinct n-grams, with its training counts, to
buckets (ranges of a hash, so none is hot; their number follows the corpus' bytes); a
bucket sums and answers; a block builds the part of the automaton that its own texts
can walk.  Blocks and buckets grow with the corpus.  Counts are over all training texts, without pruning.

Defined results: a null or empty text is the end token alone; repeated rows are
trained on and scored each; texts of any length are counted and scored whole; a null doc_id counts as the text '' for the split;
without training texts every probability is 1 / 1; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import _text
from waymark.llm._store import Scratch

FOLDS, HELD_OUT = 7, 2
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)
BLOCKS = "chunk string, ids binary, offsets binary, body binary"
SENT = "n int, bucket int, chunk string, keys binary, counts binary"
TOTALS = "n int, bucket int, chunk string, counts binary, level int, types bigint, tokens bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
NO_ID = np.iinfo(np.int64).min


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str, of=pa.RecordBatch):
    schema = _schema(ddl)
    return of.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _write_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in _text.blocks(batch.column(1), block_bytes):
                data, offsets = _text.text_bytes(batch.column(1).slice(a, b - a))
                ids = batch.column(0).slice(a, b - a).fill_null(NO_ID).to_numpy()
                yield _batch([(f"{part}-{serial}", _text.pack(ids.astype(np.int64)), _text.pack(offsets), pack.compress(data.tobytes()))], BLOCKS)
                serial += 1

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """Token hashes of a block's texts, each text as BEGIN, words, END; and its n-grams of each order."""

    def __init__(self, row: dict):
        import zstandard

        self.ids = _text.unpack(row["ids"], np.int64)
        offsets = _text.unpack(row["offsets"], np.int64)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(offsets[-1]) or 1), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        words = _text.Words(raw, offsets)
        docs = np.arange(len(self.ids))
        self.first = words.first + 2 * np.arange(len(words.first))
        self.tokens = np.empty(self.first[-1], np.uint64)
        self.tokens[np.arange(len(words.starts)) + 2 * words.owner() + 1] = words.hashes(True)
        self.tokens[self.first[:-1]] = BEGIN
        self.tokens[self.first[1:] - 1] = END
        self.owner = np.repeat(docs, np.diff(self.first))
        self.held_out = np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS == HELD_OUT for i in self.ids.tolist()], bool)

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys ascending, index of the key of each n-gram, first token of each n-gram)."""
        hashes, at = (self.tokens, np.arange(len(self.tokens))) if n == 1 else _text.windows(self.tokens, self.first, n)
        if n > 1:
            hashes = hashes >> np.uint64(64 - bits)
        keys, index = np.unique(hashes, return_inverse=True)
        return keys, index, at


def _cuts(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    edges = (np.arange(1, n_buckets, dtype=object) * (1 << bits) // n_buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _bits(n: int, bits: int) -> int:
    return 64 if n == 1 else bits


def _send(blocks: DataFrame, order: int, bits: int, n_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for n in range(1, order + 1):
                    keys, index, at = block.grams(n, bits)
                    counts = np.bincount(index, ~block.held_out[block.owner[at]], len(keys)).astype(np.uint32)
                    cuts = _cuts(keys, _bits(n, bits), n_buckets)
                    yield _batch([(n, int(k), row["chunk"], _text.pack_sorted(keys[cuts[k] : cuts[k + 1]]), _text.pack(counts[cuts[k] : cuts[k + 1]])) for k in np.flatnonzero(np.diff(cuts))], SENT)

    return blocks.mapInArrow(run, SENT)


def level_of(count: np.ndarray) -> np.ndarray:
    """Histogram level of a count: itself up to 64, then eight levels an octave."""
    return np.where(count <= 64, count, 64 + np.ceil(8 * (np.log2(np.maximum(count, 1)) - 6))).astype(np.int64)


def _total(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    n, bucket = rows[0]["n"], rows[0]["bucket"]
    keys = [_text.unpack_sorted(r["keys"]) for r in rows]
    counts = np.concatenate([_text.unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, counts, len(distinct)).astype(np.int64)
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        out.append((n, bucket, r["chunk"], _text.pack(total[index[at : at + len(k)]]), None, None, None))
        at += len(k)
    own = total[(total > 0) & (distinct != BEGIN if n == 1 else True)]
    level = level_of(own)
    types, tokens = np.bincount(level), np.bincount(level, own)
    out += [(n, bucket, None, None, int(i), int(types[i]), int(tokens[i])) for i in np.flatnonzero(types)]
    return _batch(out, TOTALS, pa.Table)


def _root(f, low: float, high: float) -> float:
    """Where a rising f crosses 0, by halving."""
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def escapes(stats: list, order: int) -> tuple[int, int, dict[int, tuple[float, float]]]:
    """(N, V, (scale, power) per order) from the counts' histograms: rows (n, level, types, tokens)."""
    of = {n: [(r["level"], r["types"], r["tokens"]) for r in stats if r["n"] == n] for n in range(1, order + 1)}
    tokens, types = sum(x[2] for x in of[1]), sum(x[1] for x in of[1])
    e = {}
    for n in range(2, order + 1):
        contexts, every = np.array([x[1] for x in of[n - 1]], float), sum(x[2] for x in of[n]) or 1
        mean = np.array([x[2] / x[1] for x in of[n - 1]])
        weight = contexts * mean / (contexts * mean).sum()
        followers = sum(x[1] for x in of[n])
        power = _root(lambda b: (contexts * mean**b).sum() - followers, 0.0, 1.0)  # noqa: B023
        unseen = min(max(sum(x[2] for x in of[n] if x[0] == 1) / every, 1e-6), 1 - 1e-6)
        share = lambda s: (weight * 10**s * mean**power / (mean + 10**s * mean**power)).sum() - unseen  # noqa: B023, E731
        e[n] = (10 ** _root(share, -8.0, 12.0), power)
    return tokens, types, e


class Automaton:
    """States: seen n-grams of up to order - 1 tokens, 0 the empty one. Arcs: sorted state * width + word."""

    def __init__(self, block: Block, counts: dict[int, np.ndarray], order: int, bits: int, tokens: int, types: int, e: dict[int, tuple[float, float]]):
        keys, index, at = block.grams(1, bits)
        self.width, self.word = len(keys), index
        self.counts = counts[1]
        begin = int(np.searchsorted(keys, BEGIN))
        p = (counts[1] + 1) / (tokens + types + 1)
        self.base = np.log10(p)
        state = 1 + np.arange(len(keys))  # state of each n-gram of the order at hand
        fail, cost = [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, weights, targets = [np.arange(len(keys))], [self.base], [np.where(counts[1] > 0, state, 0) if order > 1 else np.zeros(len(keys), np.int64)]
        self.start = int(state[begin]) if order > 1 and begin < len(keys) and keys[begin] == BEGIN and counts[1][begin] else 0
        size, below = 1, np.zeros(len(keys), np.int64)
        index_at = np.full(len(block.tokens), -1)
        index_at[at] = index
        for n in range(2, order + 1):
            # states of the (n - 1)-grams, with failure arcs to their suffixes
            fail.append(below)
            c = counts[n - 1]
            escape = e[n][0] * np.maximum(c, 1.0) ** e[n][1]
            cost.append(np.log10(escape / (c + escape)))
            size += len(c)
            own, inverse, begins = block.grams(n, bits)
            example = np.empty(len(own), np.int64)
            example[inverse] = begins
            context, suffix = index_at[example], index_at[example + 1]
            last = self.word[example + n - 1]
            p = (counts[n] + escape[context] * p[suffix]) / (c[context] + escape[context])
            seen = counts[n] > 0
            here = size + np.arange(len(own))
            arcs.append(state[context[seen]] * self.width + last[seen])
            weights.append(np.log10(p[seen]))
            targets.append((here if n < order else state[suffix])[seen])
            below = state[suffix]
            state = here
            index_at = np.full(len(block.tokens), -1)
            index_at[begins] = inverse
        self.fail, self.cost = np.concatenate(fail), np.concatenate(cost)
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs)
        self.arcs, self.weights, self.targets = arcs[by], np.concatenate(weights)[by], np.concatenate(targets)[by]

    def walk(self, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text: all texts step together, longest first, so the walking ones are a prefix."""
        lengths = np.diff(first) - 1  # without BEGIN
        by = np.argsort(-lengths, kind="stable")
        lengths, begin = lengths[by], first[:-1][by] + 1
        state, score = np.full(len(by), self.start), np.zeros(len(by))
        walking = np.searchsorted(-lengths, -np.arange(int(lengths[0])) if len(by) else np.zeros(0), side="left")
        for t, n in enumerate(walking):
            word, left = self.word[begin[:n] + t], np.arange(n)
            while len(left):
                want = state[left] * self.width + word[left]
                i = np.searchsorted(self.arcs, want)
                i[i == len(self.arcs)] = 0
                found = self.arcs[i] == want
                there = left[found]
                score[there] += self.weights[i[found]]
                state[there] = self.targets[i[found]]
                left = left[~found]
                score[left] += self.cost[state[left]]
                state[left] = self.fail[state[left]]
        out = np.empty(len(by))
        out[by] = score
        return out


def _score(order: int, bits: int, tokens: int, types: int, e: dict[int, tuple[float, float]]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block(next(r for r in rows if r["body"] is not None))
        answers = sorted((r for r in rows if r["body"] is None), key=lambda r: (r["n"], r["bucket"]))
        counts = {n: np.concatenate([_text.unpack(r["counts"], np.int64) for r in answers if r["n"] == n] or [np.zeros(0, np.int64)]) for n in range(1, order + 1)}
        automaton = Automaton(block, counts, order, bits, tokens, types, e)
        real = np.ones(len(block.tokens), bool)
        real[block.first[:-1]] = False
        owner, word, n = block.owner[real], automaton.word[real], len(block.ids)
        known = np.bincount(owner, automaton.counts[word] > 0, n).astype(np.int64)
        base = np.bincount(owner, automaton.base[word], n)
        got = [pa.array(block.ids, mask=block.ids == NO_ID), pa.array(block.held_out), pa.array(np.diff(block.first) - 1), pa.array(known), pa.array(np.full(n, tokens)), pa.array(base), pa.array(automaton.walk(block.first))]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(got, _schema(SCORES), strict=True)], schema=_schema(SCORES))

    return run


def score_texts(docs: DataFrame, order: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = scratch.table(_write_blocks(rows, _text.block_bytes(n_bytes)), "blocks")
    n_buckets = _text.bucket_count(n_bytes)
    bits = min(64, max(40, int(n_bytes).bit_length() + 18))  # so few n-grams share a key at any size
    totals = scratch.table(_send(blocks, order, bits, n_buckets).groupBy("n", "bucket").applyInArrow(_total, TOTALS), "totals")
    stats = totals.where("chunk is null").groupBy("n", "level").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()  # some hundred levels an order
    tokens, types, e = escapes(stats, order)
    answers = totals.where("chunk is not null").select("chunk", "n", "bucket", "counts", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("offsets"), F.lit(None).cast("binary").alias("body"))
    texts = blocks.select("chunk", F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "ids", "offsets", "body")
    return answers.unionByName(texts).groupBy("chunk").applyInArrow(_score(order, bits, tokens, types, e), SCORES)
