"""Quality rules: an isolation forest on rule statistics.

Rule statistics of each whole text feed a forest of random axis-parallel splits,
grown on a bounded sample of rows labelled good; a document that the splits
isolate in few steps is anomalous.  The path length below which a document is
rejected is calibrated on the labelled rows that the forest has not seen.

Defined results: a null or empty text has zero statistics and fails the base
rules; repeated rows are judged alike, each on its own; a score in the threshold's own
bin is rejected; long texts are read whole, in blocks; without labels the
forest grows on a sample of the rows that pass the base rules, and nothing but the
base rules rejects; an empty table gives no rows; other columns are ignored, or
passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import _text

# Symbols of the base rules.
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "distinct_share", "short_word_share", "top_word_share", "mean_line")
BLOCK_BYTES = 1 << 20
STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, " + ", ".join(f"{c} double" for c in FEATURES)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    with np.errstate(over="ignore"):
        return _text.mix(hashes + _text.mix(owner.astype(np.uint64) + np.uint64(1)))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and forest features of a block of texts."""
    data, offsets = _text.text_bytes(column)
    n = len(offsets) - 1
    words = _text.Words(data, offsets)
    owner, counts = words.owner(), words.counts
    hashes = words.hashes(False)
    point = (data & 0xC0) != 0x80
    inside = ~_text.SPACES[data]
    out = {"n_words": counts, "word_chars": _sums(inside & point, offsets)}
    out["n_symbols"] = _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)

    breaks = np.zeros(256, bool)
    breaks[10] = True
    lines = _text.Words(data, offsets, breaks)
    has_word = lines.ends > lines.starts
    filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    has_word &= filled[lines.ends] > filled[lines.starts]
    line_owner = lines.owner()[has_word]
    line_key = _within(_text.span_hashes(data, lines.starts[has_word], lines.ends[has_word]), line_owner)
    n_lines = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = n_lines - np.bincount(line_owner[np.unique(line_key, return_index=True)[1]], minlength=n)

    grams, at = _text.windows(hashes, words.first, 3)
    _, inverse, times = np.unique(_within(grams, owner[at]), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    cover = np.zeros(len(hashes) + 4, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover)[: len(hashes)] > 0, words.first)

    _, index, times = np.unique(_within(hashes, owner), return_index=True, return_counts=True)
    distinct = np.bincount(owner[index], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[index], times)
    size = np.diff(filled[np.stack([words.starts, words.ends])], axis=0)[0] if len(hashes) else np.zeros(0, np.int64)
    w, b = np.maximum(counts, 1), np.maximum(np.diff(offsets), 1)
    out |= {
        "mean_word": out["word_chars"] / w,
        "symbol_share": out["n_symbols"] / w,
        "repeat_share": out["n_repeat_words"] / w,
        "dup_line_share": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "upper_share": _sums((data >= 65) & (data <= 90), offsets) / b,
        "mark_share": _sums(np.isin(data, np.frombuffer(b"!?;:=_~^/\\{}[]", np.uint8)), offsets) / w,
        "digit_share": _sums((data >= 48) & (data <= 57), offsets) / b,
        "distinct_share": distinct / np.sqrt(w),
        "short_word_share": np.bincount(owner[size <= 3], minlength=n) / w,
        "top_word_share": top / w,
        "mean_line": counts / np.maximum(n_lines, 1),
    }
    out["base_failed"] = (counts < 50) | (100 * out["n_repeat_words"] > 50 * counts)
    return out


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the forest's features of every document."""
    names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                got = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c], pa.float64() if c in FEATURES else None) for c in names[1:])], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STATS_SCHEMA)


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right is the next), depth to add."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = -1.0

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / its usual value): near 1 is anomalous."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            while len(rows):
                f = self.feature[t][at[rows]]
                rows, f = rows[f >= 0], f[f >= 0]
                here = at[rows]
                at[rows] = self.left[t][here] + (x[rows, f] >= self.value[t][here])
            total += self.length[t][at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _usual(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int, subsample: int, margin: float, seed: int) -> Forest:
    """Random splits over each node's range widened by ``margin`` of itself, so that what lies outside the sample is cut off early."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    spread = np.maximum(x.max(0) - x.min(0), 1e-9)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for _ in range(trees):
        feature, value, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.choice(len(x), size, replace=False), 0)]
        while todo:
            node, rows, depth = todo.pop()
            length[node] = depth + _usual(len(rows))
            if depth >= limit or len(rows) < 2:
                continue
            f = int(rng.integers(x.shape[1]))
            low, high = x[rows, f].min(), x[rows, f].max()
            pad = margin * max(high - low, 0.05 * spread[f])
            cut = rng.uniform(low - pad, high + pad)
            feature[node], value[node], left[node] = f, cut, len(feature)
            for own in (rows[x[rows, f] < cut], rows[x[rows, f] >= cut]):
                todo.append((len(feature), own, depth + 1))
                feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
        for p, v in zip(parts, (feature, value, left, length), strict=True):
            p.append(np.array(v))
    return Forest(*parts, norm=_usual(size) or 1.0)


SCORE_BINS = 1000


def fit(stats: DataFrame, labels: DataFrame, sample: int = 8192, trees: int = 100, subsample: int = 256, margin: float = 0.25, good_cost: float = 10.0, seed: int = 7) -> Forest | None:
    """Forest and threshold; None where no row passes the base rules.

    Labelled rows that pass the base rules fall into two halves by a hash of doc_id.  The forest
    grows on at most ``sample`` good ones of the first, in the order of another hash.  The
    threshold is chosen on the whole second half, which the forest has not seen, from counts in
    SCORE_BINS score bins: the one of least ``good_cost`` * good rejected + bad kept.  Without
    good rows in the first half it grows on unlabelled ones; without good or bad rows in the
    second nothing but the base rules rejects.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    passed = stats.where("not base_failed")
    rows = passed.join(marked, "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2))
    take = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").select(*FEATURES).limit(sample).toPandas().to_numpy(float)
    x = take(rows.where("quality = 1").where(half == 0))
    calibrated = len(x) > 0
    if not calibrated:
        x = take(passed)
    if not len(x):
        return None
    forest = grow(x, trees, subsample, margin, seed)
    if not calibrated:
        return forest
    counts = _scored(rows.where(half == 1).select("quality", *FEATURES), forest).groupBy("bin", "quality").count().collect()
    good, bad = np.zeros(SCORE_BINS + 1), np.zeros(SCORE_BINS + 1)
    for r in counts:
        (good if r["quality"] == 1 else bad)[r["bin"]] += r["count"]
    # rejected: bins from k on
    cost = good_cost * np.concatenate([np.cumsum(good[::-1])[::-1], [0]]) + np.concatenate([[0], np.cumsum(bad)])
    k = len(cost) - 1 - int(np.argmin(cost[::-1]))
    if bad.sum() and good.sum():
        forest.threshold = k / SCORE_BINS
    return forest


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.floor(forest.anomaly(x) * SCORE_BINS).astype(np.int32))], names=["quality", "bin"])

    return rows.mapInArrow(run, "quality int, bin int")


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Base columns plus kept and anomaly."""
    keys = ["doc_id", *BASE, "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _text.columns(batch)
            anomaly, kept = _verdict(c["base_failed"].to_numpy(zero_copy_only=False), {f: c[f].to_numpy(zero_copy_only=False) for f in FEATURES}, forest)
            yield pa.RecordBatch.from_arrays([*(c[k] for k in keys), pa.array(kept), pa.array(anomaly)], names=[*keys, "kept", "anomaly"])

    return stats.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double")


def _verdict(failed: np.ndarray, features: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([features[f] for f in FEATURES], 1).astype(float)
    anomaly = forest.anomaly(x) if forest and len(x) else np.zeros(len(x))
    kept = ~failed.astype(bool)
    if forest and forest.threshold > 0:
        kept &= np.floor(anomaly * SCORE_BINS) < round(forest.threshold * SCORE_BINS)
    return anomaly, kept


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents, all columns as they are, without those that the base rules or the forest reject."""
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.blocks(batch.column(text), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                got = statistics(part.column(text))
                yield part.filter(pa.array(_verdict(got["base_failed"], got, forest)[1]))

    return docs.mapInArrow(run, docs.schema)
