"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier on hashed word presence is trained from confirmed toxic
examples plus unlabelled text, with the risk estimate

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

R+ and R- the mean logistic losses of calling a text toxic or not, whose second part, the risk
of the negatives, is not let fall below zero: where it would, a step goes against its gradient.

The unlabelled set is every document that is not held out, the toxic ones among them, as the
risk asks.  Word counts, risk and gradient are sums over all of them, by Spark; one small job
a step reads each text's counted words, which are written once.  The one bound of the
training, a parameter, is ``max_positive`` toxic labelled rows, first by a hash of doc_id, which the
driver holds.  Labels count only where crc32(doc_id as text) mod 5 is not 0; the prior is
their share of toxic ones.  The model estimates log odds, so the cut is at odds of one: score 0.5.

Defined results: a null or empty text scores as one without words; repeated rows
score alike, and count as often as they occur; very long texts count each word once; a margin of
exactly 0 is a score of 0.5 and predicted 1; several labels of a document count as toxic if one
does; without toxic labels every score is 0; an empty table gives no rows; other columns are
ignored, also where their names clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import _text
from waymark.llm._store import Scratch

BITS = 18
BLOCK_BYTES = 1 << 20
#: Words are runs of a-z, 0-9 and non-ASCII characters, so punctuation does not change them.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, offsets): each text's distinct word buckets, ascending."""
    data, offsets = _text.text_bytes(column)
    words = _text.Words(data, offsets, BREAKS)
    keys = np.unique(words.owner().astype(np.uint64) << np.uint64(BITS) | words.hashes(True) >> np.uint64(64 - BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margins(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(self.weights[ids])])[offsets]) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def select(n_p: np.ndarray, n_u: np.ndarray, positives: int, unlabelled: int, least_docs: int = 3, least_z: float = 2.5) -> np.ndarray:
    """Words that take part: ``least_docs`` positives have them, and positives have them more often by ``least_z`` standard errors.

    Words that are rarer among positives are left out: any large group of copies makes such.
    """
    of_p, of_u = (n_p + 0.5) / (positives + 1), (n_u + 0.5) / (unlabelled + 1)
    z = (of_p - of_u) / np.sqrt(of_p * (1 - of_p) / (positives + 1) + of_u * (1 - of_u) / (unlabelled + 1))
    return np.flatnonzero((n_p >= least_docs) & (z >= least_z))


def losses(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, sign: float) -> tuple[float, np.ndarray, float]:
    """Sums over texts, given as rows of word numbers: log(1 + exp(-sign * margin)), and its gradient by weights and bias."""
    margins = sign * (np.diff(np.concatenate([[0.0], np.cumsum(weights[ids])])[offsets]) + bias)
    slope = -sign * _sigmoid(-margins)
    return float(np.logaddexp(0, -margins).sum()), np.bincount(ids, np.repeat(slope, np.diff(offsets)), minlength=len(weights)), float(slope.sum())


def descend(positive: tuple[np.ndarray, np.ndarray], unlabelled: Callable[[np.ndarray, float], tuple[float, np.ndarray, float]], n_unlabelled: int, dims: int, prior: float, steps: int = 60, rate: float = 0.12, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole risk, at ``rate`` for three quarters of the steps, then falling to none; ``unlabelled`` gives the sums of the negatives' loss over all texts."""
    w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
    m, v = np.zeros((2, dims + 1))
    n_p = len(positive[1]) - 1
    for t in range(1, steps + 1):
        (_, plus, plus_b), (risk_p, minus, minus_b), (risk_u, own, own_b) = losses(*positive, w, b, 1.0), losses(*positive, w, b, -1.0), unlabelled(w, b)
        negative = np.append(own, own_b) / n_unlabelled - prior * np.append(minus, minus_b) / n_p
        if risk_u / n_unlabelled - prior * risk_p / n_p >= 0:
            grad = prior * np.append(plus, plus_b) / n_p + negative
        else:  # step back on the negatives' risk only
            grad = -negative
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * min(1.0, (1 - (t - 1) / steps) / 0.25) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - 0.25 * float(step[-1])  # the bias starts near its place
    return w, b


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(docs: DataFrame) -> DataFrame:
    """word, n_p, n_u over docs (text, positive): how many positives and texts have a word; word -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for a, b in _text.blocks(batch.column(0), BLOCK_BYTES):
                ids, at = features(batch.column(0).slice(a, b - a))
                positive = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                sums[0, :-1] += np.bincount(ids, np.repeat(positive, np.diff(at)), 1 << BITS).astype(np.int64)
                sums[1, :-1] += np.bincount(ids, minlength=1 << BITS)
                sums[:, -1] += positive.sum(), b - a
        words = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.where(words == 1 << BITS, -1, words)), pa.array(sums[0, words]), pa.array(sums[1, words])], names=["word", "n_p", "n_u"])

    return docs.mapInArrow(run, "word bigint, n_p bigint, n_u bigint").groupBy("word").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u"))


SETS = "ids binary, offsets binary, positive binary"


def _sets(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Blocks of texts (text, positive) as rows of numbers of the selected ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # 2 ** BITS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for a, b in _text.blocks(batch.column(0), BLOCK_BYTES):
                ids, at = features(batch.column(0).slice(a, b - a))
                number = np.minimum(np.searchsorted(words, ids), max(len(words) - 1, 0))
                mine = words[number] == ids if len(words) else np.zeros(len(ids), bool)
                offsets = np.concatenate([[0], np.cumsum(mine)])[at]
                positive = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([_text.pack(x)], pa.binary()) for x in (number[mine].astype(np.int32), offsets.astype(np.int64), positive)], names=["ids", "offsets", "positive"])

    return docs.mapInArrow(run, SETS)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _text.unpack(row["ids"], np.int32), _text.unpack(row["offsets"], np.int64), _text.unpack(row["positive"], np.uint8) > 0


def _rows(ids: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    return ids[np.repeat(take, n)], np.concatenate([[0], np.cumsum(n[take])])


def _unlabelled_risk(sets: DataFrame, dims: int) -> Callable[[np.ndarray, float], tuple[float, np.ndarray, float]]:
    """Sums of the negatives' loss and of its gradient over all texts; place dims is the bias, dims + 1 the loss."""

    def at(weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        shared = sets.sparkSession.sparkContext.broadcast((weights, bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = shared.value
            sums = np.zeros(dims + 2)
            for batch in batches:
                for row in batch.to_pylist():
                    ids, offsets, _ = _unpacked(row)
                    loss, grad, grad_b = losses(ids, offsets, w, b, -1.0)
                    sums += np.concatenate([grad, [grad_b, loss]])
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["at", "x"])

        got = sets.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # dims + 2 rows at most
        sums = np.zeros(dims + 2)
        sums[got["at"].to_numpy()] = got["x"].to_numpy()
        shared.destroy()
        return float(sums[-1]), sums[:dims], float(sums[dims])

    return at


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 5000, steps: int = 60, scratch: Scratch | None = None) -> Model | None:
    """Model, or None where no toxic label may be learnt from."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    prior = own.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    wanted = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(max_positive).collect()
    positive = F.broadcast(spark.createDataFrame([(r[0], True) for r in wanted], "doc_id bigint, positive boolean"))  # max_positive rows at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNull() | ~held_out())
    rows = rows.join(positive, "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    counts = _counts(rows).toArrow()  # 2 ** BITS + 1 rows at most
    n_p, n_u = np.zeros((2, (1 << BITS) + 1), np.int64)
    n_p[counts["word"].to_numpy()], n_u[counts["word"].to_numpy()] = counts["n_p"].to_numpy(), counts["n_u"].to_numpy()
    if not n_p[-1]:
        return None
    words = select(n_p[:-1], n_u[:-1], int(n_p[-1]), int(n_u[-1]))
    sets = scratch.table(_sets(rows, words), "sets")
    has = [_rows(*_unpacked(r)[:2], _unpacked(r)[2]) for r in _positive_blocks(sets).collect()]
    sizes = np.concatenate([np.diff(offsets) for _, offsets in has])
    known = np.concatenate([ids for ids, _ in has]), np.concatenate([[0], np.cumsum(sizes)])
    prior = min(float(prior), 0.999)
    w, b = descend(known, _unlabelled_risk(sets, len(words)), int(n_u[-1]), len(words), prior, steps)
    weights = np.zeros(1 << BITS)
    weights[words] = w
    scratch.drop()
    return Model(weights, b)


def _positive_blocks(sets: DataFrame) -> DataFrame:
    """The positives' rows of each block that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, positive = _unpacked(row)
                if positive.any():
                    ids, offsets = _rows(ids, offsets, positive)
                    yield pa.RecordBatch.from_arrays([pa.array([_text.pack(x)], pa.binary()) for x in (ids, offsets, positive[positive].astype(np.uint8))], names=["ids", "offsets", "positive"])

    return sets.mapInArrow(run, SETS)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value
        for batch in batches:
            for a, b in _text.blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                got = _sigmoid(own.margins(*features(part.column(1)))) if own else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
