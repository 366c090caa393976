"""Vectorised word splitting and hashing over Arrow string columns.

All kernels work on the UTF-8 bytes of a block of documents at once, so a
document costs no Python call of its own.  Separators and A-Z are ASCII, which
makes byte-wise work exact for any UTF-8 text.

Words are compared by 64-bit hashes, polynomials modulo 2**64 over odd byte values drawn from a
fixed seed and mixed once more: two words share one by chance once in about 2**64, but whoever
knows the seed can make words that do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The separators of [^\x20\x09-\x0D]+ .
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(separators: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


SPACES = _table(SPACE_BYTES)
#: Bytes outside [a-z0-9] and outside UTF-8 multi-byte characters, after lower-casing A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string column that hold about ``most_bytes`` each, one row at least."""
    offsets = _offsets(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a block of texts: byte spans, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:n]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1 : n + 1])) + 1
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_PRIME, _INVERSE)):
                full = np.full(n + n // 4 + 1, base, np.uint64)
                full[0] = 1
                _POWERS[i] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


#: Bytes hashed at a time: the running sums and powers of so many stay in a core's cache.
HASH_BYTES = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] of each of ascending spans: a polynomial over random byte values, from running sums."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        first, last = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(last - first + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(_VALUES[data[first:last]] * power[: last - first], out=sums[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the index of each run's first word; no run crosses a text's end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n])
    whole = np.ones(len(hashes), bool)
    ends = first[1:]
    for j in range(1, size):  # the last size - 1 words of each text begin no run
        at = ends - j
        whole[at[at >= first[:-1]]] = False
    at = np.flatnonzero(whole[:n])
    return h[at], at


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole (short) sequence."""
    with np.errstate(over="ignore"):
        h = np.full(1, len(hashes), np.uint64)
        for x in hashes:
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + x)
    return h[0]


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array: split into byte planes, then zstd."""
    raw = np.ascontiguousarray(values)
    size = raw.dtype.itemsize
    planes = raw.view(np.uint8).reshape(-1, size).T
    keep = [i for i in range(size) if planes[i].any()]
    import zstandard

    body = np.ascontiguousarray(planes[keep]).tobytes()
    return bytes([size, sum(1 << i for i in keep)]) + len(raw).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    size, kept, n = blob[0], blob[1], int.from_bytes(blob[2:10], "little")
    keep = [i for i in range(size) if kept >> i & 1]
    out = np.zeros((size, n), np.uint8)
    if keep and n:
        out[keep] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[10:]), np.uint8).reshape(len(keep), n)
    return np.ascontiguousarray(out.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """As pack(), for ascending unsigned keys: their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


LEAST_BUCKETS, BUCKET_BYTES, MOST_BUCKET_BYTES = 32, 8 << 20, 64 << 20


def bucket_count(n_bytes: int) -> int:
    """Buckets for the keys of a corpus of ``n_bytes`` of text.

    A bucket stands for BUCKET_BYTES to MOST_BUCKET_BYTES of text, more for larger corpora:
    it has to fit a task, and each block's part of a bucket should hold more than a few keys.
    """
    own = min(MOST_BUCKET_BYTES, max(BUCKET_BYTES, int((n_bytes * 1024) ** 0.5)))
    return max(LEAST_BUCKETS, n_bytes // own)


def block_bytes(n_bytes: int) -> int:
    """Bytes of text a block: 2 MB up to 64 GB of corpus, then as its square root, so that a block's part of a bucket stays worth a row, up to 16 MB, which fit a task."""
    return int(min(16 << 20, (2 << 20) * max(1.0, (n_bytes / (64 << 30)) ** 0.5)))


def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
