"""Chat formatting by columnar byte assembly.

Each Arrow batch of turns becomes one preallocated byte buffer: segment lengths,
their running sum and scatter indices are computed in numpy, then headers,
escaped contents and footers are copied to their places at once.

Template, one turn after another:

    user       <s>[INST] text [/INST]
    assistant  <a> text</s>
    any other  <r:role> text </r>

Inside texts and role names each backslash is doubled, and one backslash goes in
after the first character of every control string, so no control string is left
in a text and ``unescape`` restores it exactly.

Defined results: a null text or role is empty; rows of a conversation go by turn,
then role, then text, and equal rows stay, each as a turn; null conv_ids are one
conversation, null turns come first; texts of any length are formatted whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import _text

USER, ASSISTANT, OTHER = 0, 1, 2
HEADERS = {USER: b"<s>[INST] ", ASSISTANT: b"<a> "}
FOOTERS = {USER: b" [/INST]", ASSISTANT: b"</s>", OTHER: b" </r>"}
CONTROLS = (b"<s>", b"</s>", b"<a>", b"[INST]", b"[/INST]", b"<r:", b"</r>")
PIECE_BYTES = 1 << 20

PIECES = "conv_id bigint, first_turn bigint, piece bigint, n_turns bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|<a> (.*?)</s>|<r:(.*?)> (.*?) </r>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape(text: str) -> str:
    """Row-wise form, for role names and tests."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        c = c.decode()
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def _extra(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 before each byte that an escaping backslash precedes."""
    extra = (data == 92).astype(np.int64)
    for control in CONTROLS:
        n = len(control)
        if len(data) < n:
            continue
        at = np.flatnonzero(data[: len(data) - n + 1] == control[0])
        for j in range(1, n):
            at = at[data[at + j] == control[j]]
        ends = offsets[np.searchsorted(offsets, at, side="right")]
        extra[at[at + n <= ends] + 1] = 1
    return extra


def _scatter(out: np.ndarray, at: np.ndarray, parts: list[bytes], which: np.ndarray) -> None:
    """Copies parts[which[i]] to out[at[i]:]."""
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(lengths) - lengths
    pool = np.frombuffer(b"".join(parts), np.uint8)
    n = lengths[which]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at, n) + inner] = pool[np.repeat(begins[which], n) + inner]


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, content begin, content end) of the formatted rows."""
    data, offsets = _text.text_bytes(texts)
    names = {"user": USER, "assistant": ASSISTANT}
    kinds, headers = [], [HEADERS[USER], HEADERS[ASSISTANT]]
    other: dict[str, int] = {}
    for role in roles:
        role = role or ""
        if role in names:
            kinds.append(names[role])
            continue
        if role not in other:
            other[role] = len(headers)
            headers.append(f"<r:{escape(role).replace('>', '\\>')}> ".encode())
        kinds.append(other[role])
    kind = np.array(kinds, np.int64)
    footers = [FOOTERS[min(k, OTHER)] for k in range(len(headers))]
    extra = _extra(data, offsets)
    added = np.concatenate([[0], np.cumsum(extra)])
    body = np.diff(offsets) + np.diff(added[offsets])
    header_n = np.array([len(h) for h in headers], np.int64)[kind]
    footer_n = np.array([len(f) for f in footers], np.int64)[kind]
    rows = np.concatenate([[0], np.cumsum(header_n + body + footer_n)])
    out = np.empty(rows[-1], np.uint8)
    begin = rows[:-1] + header_n
    end = begin + body
    shift = np.repeat(begin - offsets[:-1] - added[offsets[:-1]], np.diff(offsets))
    to = np.arange(len(data)) + shift + added[1:]
    out[to] = data
    out[to[extra > 0] - 1] = 92
    _scatter(out, rows[:-1], headers, kind)
    _scatter(out, end, footers, kind)
    return out, rows, begin, end


def _pieces(batch: pa.RecordBatch, serial: int) -> tuple[pa.RecordBatch, int]:
    c = _text.columns(batch)
    roles = c["role"].to_pylist()
    out, rows, begin, end = assemble(roles, c["text"])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conv = c["conv_id"].to_pylist()
    turn = c["turn"].to_pylist()
    cuts = [0]
    for i in range(1, len(conv)):
        if conv[i] != conv[cuts[-1]] or rows[i + 1] - rows[cuts[-1]] > PIECE_BYTES:
            cuts.append(i)
    cuts.append(len(conv))
    starts, ends = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = [i for i in range(a, b) if roles[i] == "assistant"]
        base = points[rows[a]]
        starts.append((points[begin[own]] - base).tolist() if own else [])
        ends.append((points[end[own]] - base).tolist() if own else [])
    bounds = rows[cuts]
    text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    first = cuts[:-1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([conv[i] for i in first], pa.int64()), pa.array([turn[i] for i in first], pa.int64()), pa.array(range(serial, serial + len(first)), pa.int64()),
            pa.array(np.diff(cuts), pa.int64()), text, pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
        ],
        names=["conv_id", "first_turn", "piece", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def format_chat(conversations: DataFrame) -> DataFrame:
    """Formatted pieces of conversations, with the loss mask as code-point spans within each piece.

    Rows are dealt by ranges of (conv_id, turn), so a conversation that holds a
    large share of all rows is formatted by many tasks; its pieces, taken by
    (first_turn, piece), follow one another without anything between.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            for a, b in _text.blocks(batch.column(3), 4 * PIECE_BYTES):
                out = _pieces(batch.slice(a, b - a), serial)
                serial += out.num_rows
                yield out

    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).mapInArrow(run, PIECES)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, what a reader of the formatted text and its mask gets: turns and loss text as digests.

    A conversation's pieces stream through one task in order; only running
    hashes and one piece are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for row in batch.select(["conv_id", "formatted", "loss_start", "loss_end"]).to_pylist():
                if state is None or row["conv_id"] != now:
                    close()
                    now, state = row["conv_id"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text, at = row["formatted"], 0
                while at < len(text):
                    m = _TURN.match(text, at)
                    user, answer, role, other = m.groups()
                    role, body = ("user", user) if user is not None else ("assistant", answer) if answer is not None else (unescape(role), other)
                    state[2].update(f"{role}\n{unescape(body)}\n".encode())
                    state[1] += 1
                    at = m.end()
                state[5] += len(text)
                for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                    own = unescape(text[a:b])
                    state[3] += len(own)
                    state[4].update(own.encode())
            if done:
                yield flush()
        close()
        yield flush()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "piece").mapInArrow(run, DIGEST)


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, (SELECT sum((length(text) - length(replace(text, k, ''))) // length(k)) FROM (VALUES ('\'), ('<s>'), ('</s>'), ('<a>'), ('[INST]'), ('[/INST]'), ('<r:'), ('</r>')) v(k)) AS added FROM c),
f AS (SELECT *, length(text) + added + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 8 ELSE 10 + length(role) END AS chars FROM e),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
