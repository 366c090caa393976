"""SentencePiece encoding and decoding for BPE models, by a shared-prefix Viterbi.

The text is marked (U+2581 for a space, one more in front) and falls into words that no
piece crosses.  The distinct words of a block are sorted, which is a depth-first walk of
their trie: the forward column of a word is kept up to the prefix it shares with the
next, so each trie node is computed once.

The forward step is a Viterbi over pieces that end at a character, with the model's
own constraint in place of a free sum of scores: a BPE model's scores are merge ranks,
and the best sum of them is not what the model's encoder returns.  A piece may follow
another only if merging both texts by rank would leave them apart.  Under that
constraint one path survives at each character, and it is the encoder's result.  Each
node keeps the last piece and the forward score of its path.

A word's characters outside the vocabulary are byte pieces and part it.  Runs of two or
more marks have pieces of equal rank, where the constraint does not decide; a word
that begins with such a run is merged step by step instead.

Defined results: null texts have null ids, and null ids decode to null; empty texts have
no ids; repeated rows are encoded alike; texts of any length are encoded whole, in slices that end between
words; words with a character that the vocabulary lacks are merged piece by piece around its bytes; U+2581 in a text decodes to a space, all else
decodes to itself; an empty table gives no rows; other columns pass through, and
one named like the output is replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm import _text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLOCK_BYTES = 1 << 20
#: Words and piece pairs that a task remembers; more are worked out anew.
KNOWN_WORDS, KNOWN_SEAMS = 200_000, 300_000
SLICE = 1 << 20
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Vocabulary:
    """Pieces of a model with identity normalisation, a mark in front and byte fallback."""

    def __init__(self, path: str = MODEL):
        """Reads the model at a path of the driver's; executors get it from the driver."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = model.trainer_spec
        rule = model.normalizer_spec
        if kind.model_type != 2 or not kind.byte_fallback or rule.name != "identity" or not rule.add_dummy_prefix or rule.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a mark in front is needed")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(MARK in piece.lstrip(MARK) for _, piece, _ in normal):
            raise ValueError("a piece has a mark after another character")
        self.bytes = [0] * 256
        self.decoded: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
            self.decoded.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else " ⁇ ".encode() if p.type == 2 else b"")
        self.id = {piece: i for i, piece, _ in normal}
        self.score = {piece: score for _, piece, score in normal}
        self.packed = {piece: struct.pack("<i", i) for i, piece, _ in normal}
        ranks = sorted({-score for _, _, score in normal})
        rank = {r: k for k, r in enumerate(ranks)}
        self.rank = {piece: rank[-score] for _, piece, score in normal}
        #: of a piece of several characters: how its last merge parts it; pieces that merging never makes are left out
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in self.id:
            if len(piece) > 1:
                got = self.merge(piece)
                if len(got) == 1:
                    self.parts[piece] = self.last
        self.usable = {p: i for p, i in self.id.items() if len(p) == 1 or p in self.parts}
        #: trie of the usable pieces: a node maps a character to a node, and '' to its piece
        self.trie: dict = {}
        for piece in self.usable:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece

    def merge(self, word: str) -> list[str]:
        """Pieces of a word of known characters by merging step by step: best rank first, then leftmost."""
        left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        text: list[str | None] = list(word)
        heap: list[tuple[int, int, str]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (both := text[i] + text[j]) in self.rank:
                heapq.heappush(heap, (self.rank[both], i, both))

        for i in range(len(word) - 1):
            push(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if text[i] is not None else -1
            if j < 0 or text[i] + text[j] != both:
                continue
            self.last = (text[i], text[j])
            text[i], text[j] = both, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [x for x in text if x is not None]

    def apart(self, a: str, b: str) -> bool:
        """Whether merging a + b by rank leaves a and b.

        The merges that made both are undone from the last on; one across the seam
        must not come before the merge just undone (a tie goes to the left one).
        """
        rank, parts, before = self.rank, self.parts, 1 << 60
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            ra, rb = rank[a] if a in parts else -1, rank[b] if b in parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]


class Encoder:
    """Words to ids, with the words seen so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}  # ids as little-endian int32, so a text's ids are one join
        self.seams: dict[tuple[str, str], bool] = {}

    def learn(self, words: Iterable[str]) -> None:
        v, plain = self.v, []
        for word in words:
            if word[0] == MARK and word[1:2] == MARK or not all(map(v.usable.__contains__, word)):
                self.known[word] = self._rest(word)
            else:
                plain.append(word)
        plain.sort()
        self._walk(plain)

    def _rest(self, word: str) -> bytes:
        """A word with a run of marks or with unknown characters."""
        v, out, run = self.v, [], []
        for c in [*word, None]:
            if c is not None and c in v.usable:
                run.append(c)
                continue
            if run:
                out += [v.id[p] for p in v.merge("".join(run))]
                run = []
            if c is not None:
                out += [v.bytes[x] for x in c.encode()]
        return struct.pack(f"<{len(out)}i", *out)

    def _walk(self, words: list[str]) -> None:
        packed, seams, apart, score, root = self.v.packed, self.seams, self.v.apart, self.v.score, self.v.trie
        # For each character of the current branch: the last piece of the path to it, where that begins, the path's
        # score, and the pieces under way as (begin, trie node).
        last: list[str] = [""]
        origin: list[int] = [0]
        forward: list[float] = [0.0]
        under_way: list[list[tuple[int, dict]]] = [[]]
        before = ""
        for word in words:
            n = min(len(word), len(before))
            shared = 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], origin[shared + 1 :], forward[shared + 1 :], under_way[shared + 1 :]
            for end in range(shared, len(word)):
                c = word[end]
                grown = [(begin, own) for begin, node in under_way[end] if (own := node.get(c)) is not None]
                grown.append((end, root[c]))
                under_way.append(grown)
                for begin, node in grown:
                    piece = node.get("")
                    if piece is None:
                        continue
                    if begin:
                        seam = (last[begin], piece)
                        fits = seams.get(seam)
                        if fits is None:
                            fits = seams[seam] = apart(*seam)
                        if not fits:
                            continue
                    last.append(piece)
                    origin.append(begin)
                    forward.append(forward[begin] + score[piece])
                    break
            path, at = b"", len(word)
            while at:
                path = packed[last[at]] + path
                at = origin[at]
            self.known[word] = path
            before = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        known = self.known
        out: list[np.ndarray | None] = []
        split = []
        fresh: set[str] = set()
        for text in texts:
            parts = [_WORDS.findall(x) for x in _slices(text)] if text else []
            split.append(parts)
            for words in parts:
                fresh.update(words)
        self.learn(w for w in fresh if w not in known)
        for text, parts in zip(texts, split, strict=True):
            flat = b"".join(map(known.__getitem__, chain.from_iterable(parts)))
            out.append(None if text is None else np.frombuffer(flat, "<i4"))
        if len(known) > KNOWN_WORDS:  # the words of this block stay
            self.known = {w: known[w] for w in fresh}
        if len(self.seams) > KNOWN_SEAMS:
            self.seams.clear()
        return out


def _slices(text: str) -> Iterator[str]:
    """The marked text in parts of about SLICE characters that no word crosses."""
    marked = MARK + text.replace(" ", MARK)
    at = 0
    while len(marked) - at > SLICE:
        cut = at + SLICE
        while cut < len(marked) and not (marked[cut] == MARK != marked[cut - 1]):
            cut += 1
        yield marked[at:cut]
        at = cut
    if at < len(marked):
        yield marked[at:]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    raw = b"".join(map(vocabulary.decoded.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds a column of piece ids (array of int); with ``decoded`` also one with their text, read back in the same pass."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # the model's size
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    keep = [c for c in df.columns if c not in (ids, decoded)]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for a, b in _text.blocks(batch.column(at), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                got = encoder.encode(part.column(at).to_pylist())
                ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in got])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in got if x is not None)])
                out = [*(part.column(part.schema.names.index(c)) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in got]))]
                if decoded:
                    out.append(pa.array([None if x is None else decode_ids(shared.value, x) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *added]))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds a column with the text of piece ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                lists = part.column(part.schema.names.index(ids))
                own = [None if not x.is_valid else decode_ids(shared.value, x.values.to_numpy()) for x in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(c)) for c in keep), pa.array(own, pa.string())], names=[*keep, text])

    return df.mapInArrow(run, schema)
