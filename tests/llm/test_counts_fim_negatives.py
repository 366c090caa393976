"""Token counts against the library, fill-in-the-middle and hard negatives against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("waymark.llm")
from pyspark.sql import functions as F  # noqa: E402

from waymark.llm import fim, hardneg, tokens  # noqa: E402

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)


# ---- token counts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def compiled():
    return tokens.Compiled(str(P.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    return lambda texts: [len(e.ids) for e in t.encode_batch(list(texts), add_special_tokens=False)]


def mixed(seed, n):
    """Texts of what the splitter and the merges are about."""
    rng = random.Random(seed)
    pool = ["'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "\r\n", "a", "E", "re", "ve", "ll", "1", "23", "²", "é", "ß", "中", "😀", "\xa0", "　", "!", "#", "<|endoftext|>", "<|endof", "the", " and", "\x00", "́"]
    letters = "abcdehilnorst"
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(rng.randint(0, 30))) for _ in range(n // 4)]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n // 4)]


@pytest.mark.parametrize("block, chunk, states", [(1 << 21, 256, 1 << 20), (700, 3, 500)])
def test_counts_equal_the_library(compiled, library, monkeypatch, block, chunk, states):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    monkeypatch.setattr(tokens, "KNOWN_STATES", states)
    texts = mixed(5, 4000) + [c * n for c in "a -=\n_é" for n in (1, 2, 15, 16, 17, 64, 129, 1000)] + ["word's " * 400, "x" * 3000 + " y" * 900]
    classes, counter = tokens._machine(compiled)
    counter.words.clear()
    got = tokens.count_column(pa.array(texts), classes, counter, compiled.special)
    assert got.tolist() == library(texts)


def test_every_token_is_one_path(compiled):
    counter = tokens.Counter(compiled)
    rng = random.Random(2)
    assert all(counter.count(t) == 1 for t in compiled.tokens)
    words = [b"".join(rng.choices(compiled.tokens, k=rng.randint(1, 4))) for _ in range(2000)]
    first = [counter.count(w) for w in words]
    counter.forget()  # the sum along a path does not depend on what was there before
    assert [counter.count(w) for w in reversed(words)] == first[::-1]


def test_chunk_maps_compose():
    kinds = np.random.default_rng(1).integers(0, tokens.PAD, (7, 37)).astype(np.uint8)
    got = tokens.compose(tokens.chunk_maps(kinds))
    for first in range(tokens.N_STATES):
        state = first
        for chunk in range(kinds.shape[1]):
            for kind in kinds[:, chunk]:
                state = tokens._transition(state, int(kind))[0]
            assert got[chunk, first] == state


def test_token_count_edges(spark, compiled, library):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", long, "a b", "a b", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "É ß 中文 😀"]
    df = docs(spark, texts).withColumn("N_tokens", F.lit(7)).withColumn("at", F.lit(7))
    rows = {r["doc_id"]: r for r in tokens.count_tokens(df, compiled, limit=2).collect()}
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == library(t or "" for t in texts)
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert rows[3]["over_limit"] and not rows[4]["over_limit"] and rows[4]["at"] == 7
    assert tokens.count_tokens(df.limit(0), compiled).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.Compiled(str(P.path("word_bpe_49k.json")))


# ---- fill in the middle ------------------------------------------------------------------


def fim_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "é", "😀", "<", ">", "<P", "S>", "M", "\x00", "1"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "x<P>y", "<S>", "a<M>", "w " * 50_000, "a" * 100_000, "same", "same"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 1), (7, "twice", "en", "s", 1), (7, "other text", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in ("N", "form", "Output", "_fim", "at", "whole")])
    out = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = [(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], r[1], *fim_brute(r[0], r[1])) for r in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") and r["_fim"] == 7 and r["at"] == 7 for r in out.collect())
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_fim_keeps_every_repetition():
    assert fim.unit_ends("ab, c\nd") == [2, 3, 4, 5, 6, 7]
    assert fim.cuts("ab, c\nd", 7, 3) == (6, 0, 4)


# ---- hard negatives ----------------------------------------------------------------------

VECTORS = "vec_id bigint, label int, v array<double>"


def negatives_brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    own = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    width = max((len(v) for *_, v in own), default=0)
    x = np.array([[*v, *[0.0] * (width - len(v))] for *_, v in own]).reshape(len(own), width)
    out = []
    for i, (a, lab, _) in enumerate(own):
        if not anchors(a):
            continue
        s = x @ x[i]
        order = sorted((j for j in range(len(own)) if j != i), key=lambda j: (-s[j], own[j][0]))
        for p in [j for j in order if own[j][1] == lab][:positives]:
            fit = [j for j in order if own[j][1] != lab and low * s[p] <= 100 * s[j] <= high * s[p]][:negatives]
            out += [(a, own[p][0], k + 1, own[j][0], int(s[p]), int(s[j])) for k, j in enumerate(fit)]
    return sorted(out)


def clustered(n, seed, width=8, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (groups, width))
    which = rng.integers(0, groups, n)
    x = centres[which] + rng.integers(-12, 13, (n, width))
    labels = (which + (rng.random(n) < 0.4)) % 4
    return [(int(i), int(labels[i]), [float(v) for v in x[i]]) for i in range(n)]


def mined(rows_df, each=10, **more):
    out = hardneg.mine(rows_df, F.col("vec_id") % each == 0, **more)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("leaf, group, seed", [(16, 20, 1), (64, 1000, 2), (10_000, 1000, 3)])
def test_negatives_against_brute_force(spark, leaf, group, seed):
    rows = clustered(600, seed)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(150)]  # many equal vectors, many ties
    df = spark.createDataFrame(rows, VECTORS)
    got = mined(df, leaf_rows=leaf, group_rows=group, group_anchors=7, sample=200)
    assert got == negatives_brute(rows, lambda a: a % 10 == 0)
    assert got


def test_negatives_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [3.0, 4.0]), (1, 1, [3.0, 4.0]), (1, 1, [3.0, 4.0]), (2, 2, [2.0]), (3, 2, [2.0, 1.0, 0.0]), (None, 1, [1.0, 1.0]), (10, None, [1.0, 1.0]), (20, 1, None), (30, 1, [inf, 1.0]), (40, 1, [nan, 1.0]), (50, 2, [1.0, None]), (60, 3, [1.0, 1.0]), (70, 1, [-3.0, -4.0]), (80, 5, []), (0, 2, [9.0, 9.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).withColumn("leaf", F.lit(1))
    assert mined(df) == negatives_brute(rows, lambda a: a % 10 == 0)
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id = 60")) == []


def test_tree_leaves_few_leaves_and_loses_none():
    rows = clustered(4000, 4, groups=40)
    x = np.array([v for *_, v in rows])
    norms = (x * x).sum(1)
    tree = hardneg.fit(x[:1000], norms.max(), 8)
    assert tree.n_leaves >= 40
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.child),) * 2, np.inf), np.full((len(node.child),) * 2, -np.inf)

    def seen(number, far, nearest):
        node = tree.nodes[number]
        for i, j in enumerate(nearest):
            node.low[:, j], node.high[:, j] = np.minimum(node.low[:, j], far[i]), np.maximum(node.high[:, j], far[i])

    leaf = tree.descend(x, norms, seen)
    asks = np.arange(0, 4000, 50)
    s = x[asks] @ x.T
    low = -np.sort(-s, 1)[:, 20:21]
    base = (norms[asks] + tree.square)[:, None]
    inner, outer = np.sqrt(np.maximum(base - 2 * 0.98 * norms[asks][:, None], 0)), np.sqrt(np.maximum(base - 2 * low, 0))
    met = tree.reachable(x[asks], norms[asks], inner, outer)
    for i in range(len(asks)):
        inside = (s[i] >= low[i]) & (s[i] <= 0.98 * norms[asks[i]])
        assert set(leaf[inside].tolist()) <= {j for j, own in enumerate(met) if i in own}
    assert sum(map(len, met)) < 0.3 * len(asks) * tree.n_leaves
