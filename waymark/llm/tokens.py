"""Token counts by compiled finite-state transducers, for byte-level BPE tokenizers.

A tokenizer file becomes two deterministic transducers, and no token list is ever made:

* The *splitter* reads characters by class (letter, number, apostrophe, space ...).  Its transitions say
  whether a pre-token begins at this character, or at the one before where that is known a
  character late (a run of spaces gives its last one away, ``'r`` may become ``'re``).
* The *counter* reads the bytes of a pre-token.  Each transition carries how many tokens reading the byte
  adds to the count, which is 1 for a byte that stays alone, 0 or less for one that merges with what was there;
  the sum along a path is the count.  Its state is what can still matter: the longest end of the bytes
  read that begins some token, and for each place in it the last token and the count up to there.
  The last token of the bytes read so far is the one token that ends there and that merging by rank
  would leave apart from the last token before it.  States are made when first reached and kept up to
  ``KNOWN_STATES``; then the machine starts anew, with the same results.

Texts are cut in chunks of ``CHUNK`` characters.  All chunks of a block run at once, from every state of the
splitter, which gives each chunk's map from its first state to its last; a parallel
prefix scan composes the maps (in log2 of their number rounds), so every chunk's first state is known,
and a second run marks the pre-tokens.  Distinct pre-tokens of a block are counted once; each begins in the counter's first state.

A task holds one block of ``BLOCK_BYTES`` at a time.  Longer texts are parted before spaces that follow a character
other than white space, where the splitter parts them whatever comes before; a text without any such space makes one
large block.  Nothing is shuffled; the tokenizer (under 1 MB, fixed) is broadcast.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special string inside a text is one token, as
the library reads it by default; repeated rows count alike; other columns pass through and
those named like an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import _text

BLOCK_BYTES, CHUNK = 2 << 20, 256
KNOWN_STATES, KNOWN_WORDS = 200_000, 300_000
HALF = 1 << 15
OUTPUTS = ("n_bytes", "n_tokens", "over_limit")

# Classes of characters. The letters that contractions are made of have classes of their own.
LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, SPACE, WHITE, PAD = range(12)
_LETTERS = (LETTER, STMD, R, V, L, E)
_PIECES = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": R, "v": V, "l": L, "e": E}
# States: done (a pre-token has ended), in a run of letters, numbers or others, a quote that begins a pre-token, that quote
# with r, v or l, and white space: one or more, with a space or another at its end.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE = range(12)
N_STATES = N_CLASSES = 12
HERE, BEFORE = 1, 2  # a pre-token begins at this character, at the one before


def _first(kind: int) -> int:
    """The state after a pre-token's first character."""
    if kind in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, SPACE: ONE_SPACE, WHITE: ONE_WHITE}[kind]


def _transition(state: int, kind: int) -> tuple[int, int]:
    """(next state, what begins)."""
    new = (_first(kind), HERE)
    joined = {**dict.fromkeys(_LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}
    white = kind in (SPACE, WHITE)
    if state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS):
        return (state, 0) if joined.get(kind) == state and not (kind == QUOTE and state != IN_OTHERS) else new
    if state == QUOTED:
        if kind in (STMD, R, V, L):
            return {STMD: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        return (IN_OTHERS, 0) if kind in (OTHER, QUOTE) else new
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (L if state == QUOTE_L else E):
            return DONE, 0
        return (IN_LETTERS, BEFORE) if kind in _LETTERS else (new[0], BEFORE | HERE)
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if white:
            return (RUN_SPACE if kind == SPACE else RUN_WHITE), 0
        late = BEFORE if state in (RUN_SPACE, RUN_WHITE) else 0
        return (joined[kind], late) if state in (ONE_SPACE, RUN_SPACE) else (new[0], HERE | late)
    return new


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what begins) by state and class; classes from N_CLASSES on are those of a text's first character."""
    step = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
    begins = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c in range(PAD):
            step[s, c], begins[s, c] = _transition(s, c)
            step[s, N_CLASSES + c], begins[s, N_CLASSES + c] = _first(c), HERE
        step[s, PAD] = s
    return step, begins


STEP, BEGINS = _splitter()
#: A text that ends in one of these parts before its last character.
UNFINISHED = np.isin(np.arange(N_STATES), (QUOTE_R, QUOTE_V, QUOTE_L))


def _classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point, from how the library itself parts characters from a letter, a number and a mark."""
    table = np.full(0x110000, OTHER, np.uint8)
    parts = lambda text: len(pre_tokenizer.pre_tokenize_str(text))
    for low in range(0, 0x110000, 256):
        points = [c for c in range(low, low + 256) if not 0xD800 <= c < 0xE000]
        run = "".join(map(chr, points))
        if not points or low and parts("!" + run) == 1:
            continue
        if low and parts("a" + run) == 1:
            table[points] = LETTER
            continue
        for c in points:
            x = chr(c)
            if parts("a" + x) == 1:
                table[c] = LETTER
            elif parts("1" + x) == 1:
                table[c] = NUMBER
            elif parts("!" + x) > 1:
                table[c] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    for x, kind in _PIECES.items():
        table[ord(x)] = kind
    return table


class Compiled:
    """A tokenizer as its transducers; plain data until a task counts with it."""

    def __init__(self, path: str):
        """Reads the file at a path of the driver's; executors get it from the driver."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE tokenizer with its own splitting, no normaliser and no prefix space is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.classes = zlib.compress(_classes(Tokenizer.from_file(path).pre_tokenizer).tobytes())
        letters = _byte_letters()
        raw = {a: bytes(letters[x] for x in a) for a in model["vocab"] if a.encode() not in self.special}
        # By rank: the single bytes, then what each merge makes.
        self.tokens = [bytes([b]) for b in range(256)]
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        for pair in model["merges"]:
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in rank:
                raise ValueError("two merges make one token")
            self.parts.append((rank[a], rank[b]))
            rank[a + b] = len(self.tokens)
            self.tokens.append(a + b)
        if set(raw.values()) != set(self.tokens):
            raise ValueError("tokens and merges do not fit")
        self.key = zlib.crc32(repr((self.tokens, self.special)).encode())


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer; states and transitions are made when first reached."""

    START = -1

    def __init__(self, compiled: Compiled):
        self.parts = compiled.parts
        self.made_by = {pair: i for i, pair in enumerate(self.parts) if pair[0] >= 0}
        # Trie of the tokens: child by node and byte, depth, the token that ends at a node, the node of the longest proper end.
        child: dict[int, int] = {}
        depth, ends = [0], [-1]
        for i, token in enumerate(compiled.tokens):
            node = 0
            for b in token:
                at = node << 8 | b
                nxt = child.get(at)
                if nxt is None:
                    nxt = child[at] = len(depth)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        self.child, self.depth, self.ends = child, depth, ends
        shorter = [0] * len(depth)
        for at, node in sorted(child.items(), key=lambda x: depth[x[1]]):
            up, b = at >> 8, at & 255
            if up:
                up = shorter[up]
                while up and (up << 8 | b) not in child:
                    up = shorter[up]
                shorter[node] = child.get(up << 8 | b, 0)
        self.shorter = shorter
        self.seams: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (self.START << 16 | HALF,))]
        self.numbers = {self.states[0]: 0}
        self.edges: dict[int, int] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves two neighbouring tokens as they are.

        Seen from the seam the younger of both is undone, again and again. Two parts that stood side by side there
        merged if they have a merge that came before the left one's next (at equal rank the left wins) and no later than the right one's.
        """
        until_a = until_b = len(self.parts)
        while True:
            own = self.made_by.get((a, b))
            if own is not None and own < until_a and own <= until_b:
                return False
            if max(a, b) < 256:
                return True
            if a > b:
                until_a, a = a, self.parts[a][1]
            else:
                until_b, b = b, self.parts[b][0]

    def seam(self, a: int, b: int) -> bool:
        got = self.seams.get((a, b))
        if got is None:
            if len(self.seams) >= 4 * KNOWN_STATES:
                self.seams.clear()
            got = self.seams[a, b] = self.apart(a, b)
        return got

    def edge(self, state: int, byte: int) -> int:
        """The transition of a state for a byte: next state << 16 | tokens added + HALF.

        A state has, for its node and each shorter one down to the root, the place where that begins: last token << 16 | count up
        to there less the count up to here + HALF.
        """
        old, past = self.states[state]
        child, shorter, depth, ends = self.child, self.shorter, self.depth, self.ends
        node = old
        while (new := child.get(node << 8 | byte)) is None:
            node = shorter[node]
        # What ends here and begins a token lengthens something that did so before: both go from the longest to the shortest.
        at, j, own, added = new, 0, [], None
        while at:
            while depth[old] >= depth[at]:
                old, j = shorter[old], j + 1
            own.append(past[j])
            if added is None and (token := ends[at]) >= 0:
                last = past[j] >> 16
                if last == self.START or self.seam(last, token):
                    added, here = (past[j] & 0xFFFF) - HALF + 1, token
            at = shorter[at]
        if added is None:
            raise AssertionError("no token ends here: the merges are not in order")
        key = new, (*[x - added for x in own], here << 16 | HALF)
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        got = self.edges[state << 8 | byte] = number << 16 | added + HALF
        return got

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token."""
        if len(self.states) > KNOWN_STATES:
            self.forget()
        edges, state, total = self.edges, 0, 0
        for b in word:
            e = edges.get(state << 8 | b)
            if e is None:
                e = self.edge(state, b)
            state = e >> 16
            total += (e & 0xFFFF) - HALF
        return total

    def known(self, word: bytes) -> int:
        got = self.words.get(word)
        if got is None:
            got = self.count(word)
            if len(word) <= 64:
                if len(self.words) >= KNOWN_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """(chunk, state): the state after a chunk, from every first state; ``classes`` by place and chunk."""
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None, :], classes.shape[1], 0)
    flat = STEP.ravel()
    for row in classes:
        state = flat[state.astype(np.uint16) * (2 * N_CLASSES) + row[:, None]]
    return state


def compose(maps: np.ndarray) -> np.ndarray:
    """Each chunk's map after those of all chunks before it: a parallel prefix scan by doubling."""
    reach = 1
    while reach < len(maps):
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], axis=1)])
        reach *= 2
    return maps


def beginnings(kinds: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character. kinds: classes, first characters of texts raised by N_CLASSES; last: places of texts' last characters."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, PAD, np.uint8)
    padded[:n] = kinds
    by_place = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    state = np.concatenate([[DONE], compose(chunk_maps(by_place))[:-1, DONE]]).astype(np.uint8)
    marks = np.empty((CHUNK, rows), np.uint8)
    after = np.empty((CHUNK, rows), np.uint8)
    step, begins = STEP.ravel(), BEGINS.ravel()
    for j, row in enumerate(by_place):
        at = state.astype(np.uint16) * (2 * N_CLASSES) + row
        marks[j] = begins[at]
        after[j] = state = step[at]
    marks, after = marks.T.reshape(-1)[:n], after.T.reshape(-1)[:n]
    out = (marks & HERE) > 0
    out[:-1] |= (marks[1:] & BEFORE) > 0
    out[last[UNFINISHED[after[last]]]] = True
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each character, code point) of UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    many = np.flatnonzero(lead >= 0xC0)
    if len(many):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        a, b = at[many], lead[many]
        c1, c2, c3 = (wide[a + i] & 0x3F for i in (1, 2, 3))
        two, three = (b & 0x1F) << 6 | c1, (b & 0x0F) << 12 | c1 << 6 | c2
        lead[many] = np.minimum(np.where(b < 0xE0, two, np.where(b < 0xF0, three, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3)), 0x10FFFF)
    return at, lead


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts (bytes, offsets) begin; they cover all bytes, and none crosses texts."""
    at, points = code_points(data)
    if not len(at):
        return at
    kinds = classes[points]
    own = np.unique(offsets[:-1][np.diff(offsets) > 0])
    first = np.searchsorted(at, own)
    kinds[first] += N_CLASSES
    return at[beginnings(kinds, np.append(first[1:], len(at)) - 1)]


def _segments(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """((text, first byte, end) of what is tokenised by itself, special strings of each text): texts are cut at special strings, long ones before safe spaces."""
    found = np.zeros(len(offsets) - 1, np.int64)
    out: list[tuple[int, int, int]] = []
    raw = data.tobytes() if special else b""
    cut_texts: dict[int, list[tuple[int, int]]] = {}
    for word in special:
        at = raw.find(word)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, side="right")) - 1
            inside = at + len(word) <= offsets[i + 1] and all(e <= at or s >= at + len(word) for s, e in cut_texts.get(i, ()))
            if inside:
                cut_texts.setdefault(i, []).append((at, at + len(word)))
                found[i] += 1
            at = raw.find(word, at + (len(word) if inside else 1))
    for i in range(len(offsets) - 1):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        for s, e in [*sorted(cut_texts.get(i, ())), (end, end)]:
            while s - begin > BLOCK_BYTES:  # the next safe space after a block's worth
                part = data[begin + BLOCK_BYTES - 1 : s]
                safe = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
                if not len(safe):
                    break
                cut = begin + BLOCK_BYTES + int(safe[0])
                out.append((i, begin, cut))
                begin = cut
            if s > begin:
                out.append((i, begin, s))
            begin = e
    return out, found


def count_block(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, counter: Counter) -> np.ndarray:
    """Tokens of each text of a block without special strings."""
    starts = pre_tokens(data, offsets, classes)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    ends = np.append(starts[1:], len(data))
    _, at, which = np.unique(_text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like, size = starts[at][which], ends - starts
    same = np.array_equal(size[at][which], size) and np.array_equal(data[np.arange(len(data)) + np.repeat(like - starts, size)], data)
    if not same:  # two pre-tokens share a hash
        at, which = np.arange(len(starts)), np.arange(len(starts))
    raw, known = data.tobytes(), counter.known
    counts = np.array([known(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.int64)
    sums = np.concatenate([[0], np.cumsum(counts[which])])
    first = np.searchsorted(starts, offsets)
    return sums[first[1:]] - sums[first[:-1]]


def count_column(column: pa.Array, classes: np.ndarray, counter: Counter, special: list[bytes]) -> np.ndarray:
    """Tokens of each text of an Arrow column; null is empty."""
    total = np.zeros(len(column), np.int64)
    for a, b in _text.blocks(column, BLOCK_BYTES):
        data, offsets = _text.text_bytes(column.slice(a, b - a))
        parts, found = _segments(data, offsets, special)
        total[a:b] += found
        i = 0
        while i < len(parts):
            j, size = i + 1, parts[i][2] - parts[i][1]
            while j < len(parts) and size + parts[j][2] - parts[j][1] <= BLOCK_BYTES:
                size += parts[j][2] - parts[j][1]
                j += 1
            own = parts[i:j]
            sizes = np.array([e - s for _, s, e in own])
            joined = data[own[0][1] : own[-1][2]] if own[-1][2] - own[0][1] == size else np.concatenate([data[s:e] for _, s, e in own])
            counts = count_block(joined, np.concatenate([[0], np.cumsum(sizes)]), classes, counter)
            np.add.at(total, a + np.array([t for t, _, _ in own]), counts)
            i = j
    return total


_ready: dict = {}


def _machine(compiled: Compiled) -> tuple[np.ndarray, Counter]:
    """A worker's own transducers, made once."""
    if compiled.key not in _ready:
        _ready.clear()
        _ready[compiled.key] = np.frombuffer(zlib.decompress(compiled.classes), np.uint8), Counter(compiled)
    return _ready[compiled.key]


def count_tokens(docs: DataFrame, compiled: Compiled, limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled)

    @F.arrow_udf(T.LongType())
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, counter = _machine(sent.value)
        for column in columns:
            yield pa.array(count_column(column, classes, counter, sent.value.special))

    own = [c for c in docs.columns if c.lower() not in OUTPUTS]
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    out = docs.select(*own, n_bytes.alias("n_bytes"), count(F.col("text")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
