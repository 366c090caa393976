"""Each operator on small tables: against brute force, and on nulls, empty, long, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("waymark.llm")
from pyspark.sql import functions as F  # noqa: E402

from waymark.llm import _text, chat, decontam, jaccard, linededup, lm, pieces, pii, quality, toxicity, urls  # noqa: E402
from waymark.llm._store import Scratch, join_salted, join_split  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Null, empty, blank, long, tied and repeated texts, a null id, and columns that clash with outputs."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b"), (6, "a b"), (6, "a b"), (None, "a b c d e f g h i j k l"), (8, "É é ß 中文 😀\n" * 3)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)
    clash = ["score", "kept", "ids", "decoded", "key", "w", "at", "level", "rep", "label", "n", "id", "hash", "_cuts"]
    return df.select("*", *[F.lit(7).alias(c) for c in clash])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def corpus(n=120, seed=1):
    """Texts with exact and near copies and shared lines."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.45:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocab) + ("\n" if rng.random() < 0.05 else "") for _ in range(rng.choice([0, 1, 3, 30, 80, 150]))))
    return [t if rng.random() < 0.97 else None for t in out]


# ---- kernels -------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["Ab  cd\n", "", None, "cd", "é x ab", "\x0b\x0c x"]
    data, offsets = _text.text_bytes(pa.array(texts))
    w = _text.Words(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [words(t, False) for t in texts]
    h = w.hashes(True)
    flat = [x for t in texts for x in words(t)]
    same = {}
    for x, k in zip(flat, h):
        assert same.setdefault(x, k) == k
    assert len(set(same.values())) == len(same)


def test_pack():
    for values in (np.array([], np.uint64), np.array([1, 5, 1 << 60], np.uint64)):
        assert (_text.unpack_sorted(_text.pack_sorted(values)) == values).all()
    x = np.array([0, -3, 7], np.int64)
    assert (_text.unpack(_text.pack(x), np.int64) == x).all()


def test_windows_stay_in_texts():
    data, offsets = _text.text_bytes(pa.array(["a b c", "a b", "", "b c a b c"]))
    w = _text.Words(data, offsets)
    grams, at = _text.windows(w.hashes(True), w.first, 3)
    assert at.tolist() == [0, 5, 6, 7] and grams[0] == grams[3] and len(set(grams.tolist())) == 3


# ---- 1 quality -------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w, seen, again = words(t, False), set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    c, rep = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), again, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality_statistics(spark):
    texts = [*corpus(60), "a b c a b c", "x\n x\nx\n\n\nx", "# $ |é|", LONG]
    rows = quality.rule_statistics(docs(spark, texts)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(texts[r["doc_id"]])


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice("the of and river stone walks over quiet green hills near old town".split()) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(60, 200))) for _ in range(300)]
    junk = [" ".join(f"{rng.randrange(99)}|{rng.choice('#$%')}{rng.randrange(9999)}!!" for _ in range(100)) for _ in range(40)]
    df = docs(spark, prose + junk)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(340) if i % 2], "doc_id bigint, quality int, toxic int")
    stats = quality.rule_statistics(df).cache()
    forest = quality.fit(stats, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(stats, forest).collect()}
    failed = {r["doc_id"] for r in stats.where("base_failed").collect()}
    good = [i for i in range(300) if i not in failed]
    assert sum(kept[i] for i in good) >= 0.97 * len(good)
    assert not any(kept[i] for i in range(300, 340))
    assert {r["doc_id"] for r in quality.keep_good(df, forest).collect()} == {i for i, k in kept.items() if k}


def test_quality_edges(spark):
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    stats = quality.rule_statistics(odd(spark))
    forest = quality.fit(stats, no_labels)
    out = quality.judge(stats, forest)
    assert out.count() == 9 and {r["doc_id"] for r in out.where("kept").collect()} <= {4}
    assert quality.keep_good(odd(spark), forest).columns == odd(spark).columns
    nothing = quality.rule_statistics(empty(spark))
    assert quality.fit(nothing, no_labels) is None and quality.judge(nothing, None).count() == 0


# ---- 2 personal data ----------------------------------------------------------------------------

_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    twice = {c: str(sum(map(int, str(2 * int(c))))) for c in "0123456789"}
    return sum(int(c if i % 2 == 0 else twice[c]) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]

    return {k: [m.span() for m in re.finditer(p, t) if good(k, m[0])] for k, p in _KINDS.items()}


def test_fixed_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1.2@+-() %_é9 0:4") for _ in range(rng.randint(0, 40)))
        assert pii.find_spans(t) == brute_spans(t)
    for t in ("4111 1111 1111 1111", "a@b.c-d@e.f", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 5000, "+" + "(" * 5000, "a" * 100_000, "@" * 1000):
        assert pii.find_spans(t) == brute_spans(t)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice("the and of it was here then".split()) for _ in range(12))
    texts = [f"{fill()} mobile +1 (212) 555-{rng.randint(1000, 9999)} {fill()}" for _ in range(40)]
    texts += [f"{fill()} mobile 555-{rng.randint(10_000, 99_999)} {fill()}" for _ in range(4)] + [f"{fill()} the 12345 {fill()}" for _ in range(4)]
    rows = {r["doc_id"]: r for r in pii.extract(docs(spark, texts)).collect()}
    assert all(rows[i]["n_phone"] == 1 and not rows[i]["found"] for i in range(40))
    for i in range(40, 44):
        (s,) = rows[i]["found"]
        assert texts[i][s["first"] : s["last"]].startswith("555-")
    assert not any(rows[i]["found"] for i in range(44, 48))


def test_copies_and_many_unseen_identifiers_keep_a_pattern(spark):
    rng = random.Random(14)
    fill = lambda: " ".join(rng.choice("the and of it was here then".split()) for _ in range(12))
    texts = [f"{fill()} mobile +1 (212) 555-{i:04} {fill()}" for i in range(40)]
    texts += [f"{fill()} mobile 555-{i:05} {fill()}" for i in range(41)] + [f"{fill()} mobile 777-12345 {fill()}"] * 100 + [f"{fill()} mobile rang {fill()}"] * 100
    rows = {r["doc_id"]: r for r in pii.extract(docs(spark, texts)).collect()}
    for i in range(40, 181):
        (s,) = rows[i]["found"]
        assert texts[i][s["first"] : s["last"]].startswith(("555-", "777-"))
    assert not any(rows[i]["found"] for i in [*range(40), *range(181, 281)])


def brute_pieces(t):
    """(start, end, lower-cased piece) of the runs of letters and digits, or of other marks."""
    return [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", t)]


def brute_discover(texts, rounds=3, confident=0.5, support=5):
    """Spans that patterns find, straight from the definition."""
    edges, spans = {}, []
    for i, t in enumerate(texts):
        taken = [s for v in brute_spans(t).values() for s in v]
        mine = [(a, b, 1.0) for a, b in taken]
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            own = m[0].strip(pii._TRIM)
            a = m.start() + len(m[0]) - len(m[0].lstrip(pii._TRIM))
            b = a + len(own)
            if own and ("@" in own or sum(c in "0123456789" for c in own) >= 3) and not any(x < b and a < y for x, y in taken):
                mine.append((a, b, 0.5 if pii.CREDENTIAL.fullmatch(own) else 0.0))
                spans.append((i, a, b, own.lower()))
        for a, b, prior in mine:
            left = [p for _, e, p in brute_pieces(t[:a])][::-1][:3]
            right = [p for _, _, p in brute_pieces(t[b:])][:3]
            for side, near in (("left", left), ("right", right)):
                for n in range(1, len(near) + 1):
                    by = edges.setdefault((side, tuple(near[:n]), pii.shape(t[a:b])), {})
                    by[t[a:b].lower()] = max(by.get(t[a:b].lower(), 0.0), prior)
    prose = {}
    for t in texts:
        pieces = [p for _, _, p in brute_pieces(t)]
        marked = []
        for a, _, _ in brute_pieces(t):
            (token,) = [m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m.start() <= a < m.end()]
            marked.append(any(c in "0123456789@" for c in token))
        for i in range(len(pieces)):
            for side, step in (("left", -1), ("right", 1)):
                after = [pieces[i - step * d] if 0 <= i - step * d < len(pieces) else None for d in (1, 2)]
                if after[0] is not None and marked[i - step]:
                    continue
                for n in range(1, 4):
                    if 0 <= i + step * (n - 1) < len(pieces):
                        prose.setdefault((side, tuple(pieces[i + step * d] for d in range(n))), set()).add(tuple(after))
    score = {}
    for by in edges.values():
        for token, prior in by.items():
            score[token] = max(score.get(token, 0.0), prior)
    for _ in range(rounds):
        best = {}
        for (side, near, kind), by in edges.items():
            own = [max(by[t], score.get((t, "got"), 0.0)) for t in by]
            if sum(x >= confident for x in own) >= support:
                p = sum(own) / (sum(own) + len(prose.get((side, near), ())))
                if p >= confident:
                    for t in by:
                        best[t, side] = max(best.get((t, side), 0.0), p)
        score = {(t, "got"): 1 - (1 - best.get((t, "left"), 0.0)) * (1 - best.get((t, "right"), 0.0)) for t, _ in best}
    return {(i, a, b) for i, a, b, own in spans if score.get((own, "got"), 0.0) >= confident}


@pytest.mark.parametrize("most_broadcast", [1_000_000, 7])
def test_bootstrapping_against_brute_force(spark, most_broadcast):
    rng = random.Random(21)
    word = lambda: rng.choice("the and of it was Here then é, by; (so) no.".split())
    fill = lambda n=8: " ".join(word() for _ in range(rng.randint(1, n)))
    number = lambda: str(rng.randrange(10**4, 10**7))
    make = [
        lambda: f"call: +1 (212) 555-{rng.randrange(1000, 9999)} now",
        lambda: f"call: {number()} now",
        lambda: f"{number()} now is",
        lambda: f'key = "{rng.getrandbits(160):040x}"',
        lambda: f'key = "{rng.getrandbits(40):010x}"',
        lambda: f"{rng.getrandbits(160):040x}",
        lambda: f"mail of a{rng.randrange(60)}@b.example",
        lambda: f"the {number()}",
        lambda: "call: me now",
        lambda: "key = none",
    ]
    texts = [" ".join([fill(), rng.choice(make)(), fill(4), rng.choice(make)(), fill(3)]) for _ in range(120)]
    texts += texts[:30] + ["", "call: 55512345 now"]
    rows = {r["doc_id"]: r for r in pii.extract(docs(spark, texts), most_broadcast=most_broadcast).collect()}
    got = {(i, s["first"], s["last"]) for i in rows for s in rows[i]["found"]}
    want = brute_discover(texts)
    assert got == want and len(want) > 20


def test_pii_edges(spark):
    long = "x " * 300_000 + "a@b.example " + "y" * 100_000
    rows = pii.extract(docs(spark, [long, long])).collect()
    assert [(r["n_email"], r["base"]) for r in rows] == [(1, f"email:{long.index('a@')}:{long.index('a@') + 11}")] * 2
    assert pii.extract(empty(spark)).count() == 0
    assert pii.extract(odd(spark)).where("base = ''").count() == 9

def test_pii_reads_the_corpus_once_however_much_is_asked(spark, monkeypatch):
    passes = []
    tables = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: passes.append(name) or tables(self, df, name))
    texts = [f"w{i % 40} v{i % 30} code {10_000 + i} u{i % 20} done" for i in range(400)]
    pii.extract(docs(spark, texts), most_broadcast=3).collect()
    assert passes.count("prose") == passes.count("found") == 1


def test_pii_counter_forgets_without_loss():
    """Listed or filtered, remembered or forgotten: the same contexts up to what decides."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    blocks = [pii.Pieces(*_text.text_bytes(pa.array([t]))) for t in texts]
    keys = np.unique(np.concatenate([next(pii._chain([b.hashes])) for b in blocks]))
    many, none = np.full(len(keys), 1000), np.zeros(0, np.uint64)
    words = np.zeros(64, np.uint64)
    np.bitwise_or.at(words, (keys >> np.uint64(58)).astype(int), np.uint64(1) << (keys & np.uint64(63)) | np.uint64(1) << (keys >> np.uint64(6) & np.uint64(63)))
    assert pii._in_filter(keys, words).all() and pii._in_filter(_text.mix(np.arange(10_000, dtype=np.uint64)), words).mean() < 0.1

    def pairs(counter):
        return {(int(k), int(c)) for b in blocks for k, c in zip(*counter.add(b), strict=True) if k in keys}

    listed = pairs(pii._Counter(pii.Asked(keys, many, None, 0), 1))
    assert len(listed) > 200
    for room in (1 << 20, 3):
        assert pairs(pii._Counter(pii.Asked(none, none.astype(np.int64), words, 1000), 1, room)) == listed
    exact = np.array([sum(k == key for k, _ in listed) + 1 for key in keys.tolist()])  # one more than there are: all must come
    assert pairs(pii._Counter(pii.Asked(keys[::2], exact[::2], words, int(exact.max())), 1, room=3)) == listed
    few = Counter(k for k, _ in pairs(pii._Counter(pii.Asked(none, none.astype(np.int64), words, 9), 1)))
    assert set(few.values()) == {9}


def test_pii_hot_tokens_are_joined_apart(spark):
    rows = spark.createDataFrame([(i, b"hot" if i % 3 else bytes([i % 200])) for i in range(6000)], "row int, token binary")
    got = spark.createDataFrame([(b"hot", 0.5), (bytes([7]), 0.25), (b"none", 1.0)], "token binary, got double")
    hot = pii.hot_tokens(rows, 6000, Scratch(spark, "t"), "hot")
    assert [bytes(r[0]) for r in hot.collect()] == [b"hot"]
    for how in ("left", "left_semi"):
        plain = rows.join(got, "token", how)
        for most in (1, 100):
            assert Counter(map(str, pii.by_token(rows, got, hot, most, how).select(*plain.columns).collect())) == Counter(map(str, plain.collect()))


# ---- 3 URLs -------------------------------------------------------------------------------

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for _, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules_and_edges(spark):
    sample = [None, "", "x", "http://", "http://A.Net", "http://A.Net/", "http://a.example.net/en/1?x=://y", "http://example.com/de/#a", "https://b.org/fr/x", "http://xnet/", "http://net/?a", "http://a\nb.net/x", "http://long.org/" + "é/x9" * 50_000] + ["http://b.org/en/1"] * 3
    df = spark.createDataFrame([(i, u, "h", 1, 2) for i, u in enumerate(sample)], "page_id bigint, url string, html string, s int, score int")
    rows = urls.judge_urls(df, RULES).collect()
    assert len(rows) == len(sample)
    action = dict((r, a) for a, r in RULES)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(sample[r["page_id"]])
        assert r["verdict"] == action[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
        if "://" not in (sample[r["page_id"]] or ""):  # null, empty or without a scheme
            assert (r["verdict"], r["score"]) == ("allow", None)
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


def test_url_model_parts_two_styles(spark):
    rng = random.Random(5)
    good = lambda: f"http://{rng.choice(['news', 'daily', 'journal'])}{rng.choice(['paper', 'post', 'times'])}.example.org/"
    bad = lambda: f"http://{rng.choice(['xx', 'zq', 'qz'])}{rng.choice(['casino', 'kazino'])}{rng.randrange(99)}.example.org/"
    data = [(good() + "ok/1", 1) for _ in range(60)] + [(bad() + "no/1", 0) for _ in range(60)] + [(good() + "p/1", 1) for _ in range(40)] + [(bad() + "p/1", 0) for _ in range(40)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(data)], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, [("allow", "org/ok/"), ("block", "org/no/")]).collect()}
    assert sum((got[i] == "allow") == bool(y) for i, (_, y) in enumerate(data) if i >= 120) >= 76


# ---- 4 Jaccard -------------------------------------------------------------------------------


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2), (2, 50, 100, 3)])
def test_jaccard_components(spark, size, num, den, seed):
    texts = corpus(150, seed)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs(spark, texts), size, num, den).collect()}
    want = brute_components(texts, size, num, den)
    assert [rows[i] for i in range(len(texts))] == want
    if seed == 2:
        assert sorted(r["doc_id"] for r in jaccard.keep_first(docs(spark, texts), size, num, den).collect()) == [i for i, (_, c) in enumerate(want) if c == i]


def test_jaccard_hub_group(spark):
    """Copies of one text with a few edits each: some link only to some others, none is the original."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        texts.append(" ".join(w))
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(docs(spark, texts), 4, 85, 100).collect()}
    assert [rows[i] for i in range(120)] == [c for _, c in brute_components(texts, 4, 85, 100)]


def block_texts(n, seed=4):
    """Texts of 10 of 40 blocks of 12 words each, a few with an edit of another one's."""
    rng = random.Random(seed)
    blocks = [" ".join(f"k{i}w{j}" for j in range(12)) for i in range(40)]
    texts = []
    for i in range(n):
        if i % 10 == 9:
            w = texts[rng.randrange(i)].split()
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(blocks[k] for k in sorted(rng.sample(range(40), 10))))
    return texts


def test_jaccard_far_members(spark):
    """Texts that share blocks, most of them far from their lists' hubs, and a few copies with an edit."""
    texts = block_texts(200)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs(spark, texts), 4, 85, 100).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, 4, 85, 100)


def test_jaccard_key_bits(spark, monkeypatch):
    """Keys widen with the corpus, and the widest give the same components."""
    assert [jaccard.key_bits(n) for n in (0, 1 << 33, 1 << 40, 10**14, 1 << 60)] == [48, 48, 55, 61, 63]
    monkeypatch.setattr(jaccard, "key_bits", lambda n: 63)
    texts = corpus(150, 1)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs(spark, texts), 4, 85, 100).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, 4, 85, 100)


def test_jaccard_edges(spark):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(odd(spark)).collect()]
    assert sorted(r for r in rows if r[0] and r[0] < 4) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert sorted(r for r in rows if r[0] in (5, 6)) == [(5, 1, 5), (6, 1, 5), (6, 1, 5)]
    assert [r for r in rows if r[0] is None] == [(None, 8, None)]
    assert jaccard.link_components(empty(spark)).count() == 0
    kept = jaccard.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]


# ---- 5 pieces -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def test_pieces_equal_the_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(7)
    letters = [*"abcdefghijklmnopqrstuvwxyz ABC0123456789.,'\n\t▁éüß😀中文", "the", "ing ", "  ", "́", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * k for k in range(40)] + corpus(40) + [LONG]
    got = pieces.Encoder(vocabulary).encode(texts)
    for t, ids in zip(texts, got):
        assert (ids is None) if t is None else ids.tolist() == model.encode(t)
        if t is not None:
            assert pieces.decode_ids(vocabulary, ids) == t.replace("▁", " ") == model.decode(ids.tolist())


def test_long_texts_part_between_words(vocabulary, monkeypatch):
    want = pieces.Encoder(vocabulary).encode([LONG[:5000], "x" * 300 + " y  z"])
    monkeypatch.setattr(pieces, "SLICE", 50)
    got = pieces.Encoder(vocabulary).encode([LONG[:5000], "x" * 300 + " y  z"])
    assert all((a == b).all() for a, b in zip(want, got))


def test_pieces_edges(spark, vocabulary):
    out = pieces.decode(pieces.encode(odd(spark), vocabulary), vocabulary)
    rows = out.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == 9
    for r in rows:
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    assert pieces.encode(empty(spark), vocabulary).count() == 0
    assert [r["d"] for r in pieces.encode(docs(spark, ["a b", None]), vocabulary, decoded="d").collect()] == ["a b", None]


# ---- 6 language model -------------------------------------------------------------------------------


def brute_counts(texts):
    """n-gram counts of the training texts, each text as <, words, >."""
    tokens = [["<", *words(t), ">"] for t in texts]
    counts = {n: Counter() for n in (1, 2, 3)}
    for i, t in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for n in counts:
                counts[n].update(tuple(t[j : j + n]) for j in range(len(t) - n + 1))
    return tokens, counts


def brute_lm(tokens, counts, e):
    import math

    one = Counter({g: c for g, c in counts[1].items() if g != ("<",)})
    n, v = sum(one.values()), len(one)

    def p(gram):
        if len(gram) == 1:
            return (one[gram] + 1) / (n + v + 1)
        c = counts[len(gram) - 1][gram[:-1]]
        own = e[len(gram)][0] * c ** e[len(gram)][1] if c else 1
        return (counts[len(gram)][gram] + own * p(gram[1:])) / (c + own)

    out = []
    for t in tokens:
        base = sum(math.log10(p((w,))) for w in t[1:])
        score = sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(1, len(t)))
        out.append((len(t) - 1, sum(one[(w,)] > 0 for w in t[1:]), n, base, score))
    return out


def test_lm_scores(spark, monkeypatch):
    texts = corpus(80)
    seen = {}
    keep = lm.escapes
    monkeypatch.setattr(lm, "escapes", lambda *a: seen.setdefault("e", keep(*a)))
    rows = {r["doc_id"]: r for r in lm.score_texts(docs(spark, texts)).collect()}
    tokens, counts = brute_counts(texts)
    e = seen["e"][2]
    for i, want in enumerate(brute_lm(tokens, counts, e)):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-9) and r["score"] == pytest.approx(want[4], abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    # The fit, from the counts themselves rather than histograms: followers add up, and the mean weight is the share of n-grams seen once.
    for n in (2, 3):
        context = Counter({g: c for g, c in counts[n - 1].items() if g != ("<",)})
        scale, power = e[n]
        assert sum(c**power for c in context.values()) == pytest.approx(len(counts[n]), rel=0.02) or power in (0.0, 1.0)
        weight = sum(c * scale * c**power / (c + scale * c**power) for c in context.values()) / sum(context.values())
        assert weight == pytest.approx(sum(c == 1 for c in counts[n].values()) / sum(counts[n].values()), rel=0.02)


def test_lm_is_a_distribution():
    """Over all words after any context, probabilities and the failure mass sum to one."""
    texts = ["a b a c", "a b b", "c a"]
    tokens, counts = brute_counts(texts * 7)
    vocabulary = sorted(g for (g,) in counts[1] if g != "<")
    e = {2: (1.5, 0.5), 3: (0.7, 0.9)}
    sums = Counter()
    for a, b in [("a", "b"), ("<", "c"), ("c", "a"), ("x", "a")]:
        for w in [*vocabulary, "unseen"]:
            sums[a, b] += 10 ** (brute_lm([["<", a, b, w]], counts, e)[0][4] - brute_lm([["<", a, b]], counts, e)[0][4])
    assert all(x == pytest.approx(1) for x in sums.values())


def test_lm_higher_order_and_held_out(spark):
    texts = corpus(80)
    base = lm.score_texts(docs(spark, texts), order=2).agg(F.sum("score")).first()[0]
    more = lm.score_texts(docs(spark, texts), order=4).agg(F.sum("score")).first()[0]
    assert base < 0 and more < 0
    rng = random.Random(8)
    pairs = [(f"x{i}", f"y{i}") for i in range(30)]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(120)]
    held = lm.score_texts(docs(spark, texts)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.7 * held[1]


def test_lm_edges(spark):
    rows = [(r["doc_id"], r["n_tokens"]) for r in lm.score_texts(odd(spark)).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 60_001), (5, 3), (6, 3), (6, 3), (None, 13), (8, 16)], key=str)
    assert lm.score_texts(empty(spark)).count() == 0
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert lm.score_texts(docs(spark, ["a b"], only)).first()["score"] == 0


# ---- 7 lines -------------------------------------------------------------------------------


def brute_lines(texts, least):
    """Deletes every line of a run of least words or more that occurs before: all runs, all places."""
    docs_ = []
    for t in texts:
        lines = [] if t is None else t.split("\n")
        docs_.append((lines, [i for i, x in enumerate(lines) if words(x)]))
    first = {}
    runs = []
    for d, (lines, raw) in enumerate(docs_):
        for a in range(len(raw)):
            for b in range(a, len(raw)):
                name = tuple(lines[i] for i in raw[a : b + 1])
                if sum(len(words(x)) for x in name) >= least:
                    runs.append((name, d, a, b))
                    first.setdefault(name, (d, a))
    gone = [set() for _ in texts]
    for name, d, a, b in runs:
        if first[name] != (d, a):
            lines, raw = docs_[d]
            gone[d] |= set(range(raw[a], raw[b + 1] if b + 1 < len(raw) else len(lines)))
    return [None if t is None else "\n".join(x for i, x in enumerate(docs_[d][0]) if i not in gone[d]) for d, t in enumerate(texts)]


@pytest.mark.parametrize("least, seed", [(1, 1), (6, 2), (6, 3), (17, 4)])
def test_line_dedup(spark, least, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 1, 2, 5, 9]))) for _ in range(25)] + ["", " "]
    block = [[rng.choice(pool) for _ in range(rng.randint(1, 8))] for _ in range(6)]
    texts = []
    for _ in range(40):
        lines = [x for _ in range(rng.randint(0, 4)) for x in (rng.choice(block) if rng.random() < 0.5 else [rng.choice(pool)])]
        texts.append("\n".join(lines) if rng.random() < 0.95 else None)
    rows = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, texts), least).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_lines(texts, least)


def test_line_dedup_edges(spark):
    out = linededup.dedup_lines(odd(spark))
    assert out.columns == [*odd(spark).columns, "removed_lines"] and out.count() == 9
    assert out.where("size(removed_lines) > 0").count() == 0
    assert linededup.dedup_lines(empty(spark)).count() == 0
    passage = " ".join(f"p{i}" for i in range(60))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, [f"one\n{passage}", f"two\n{passage}\n\nthree", passage])).collect()}
    assert got == {0: f"one\n{passage}", 1: "two\nthree", 2: ""}


def test_line_dedup_many_lines(spark):
    """One text of 20,000 lines, its copy, and one line in every document."""
    long = "\n".join(f"line {i % 9000} of many x{i % 7}" for i in range(20_000))
    common = " ".join(f"c{i}" for i in range(60))
    texts = [long, f"{long}\nmore"] + [f"own {i}\n{common}" for i in range(3000)]
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert rows[0]["text"] == long and rows[1]["text"] == "more"
    assert rows[2]["text"] == texts[2] and all(rows[i]["text"] == f"own {i - 2}" for i in range(3, len(texts)))


def test_join_split_and_salted(spark):
    """Hot keys broadcast or salted give the same rows as a plain join."""
    scratch = Scratch(spark, "split")
    rows = scratch.table(spark.range(5000).selectExpr("id", "CASE WHEN id < 3000 THEN -1 ELSE id % 50 END AS k"), "rows")
    counts = scratch.table(rows.groupBy("k").agg(F.count("*").alias("many")), "counts")
    members = scratch.table(counts.selectExpr("k", "many", "explode(array(1, 2, 3)) AS m"), "members")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(join_split(rows, counts, ["k"], 5000, 4).select("id", "many")) == plain(rows.join(counts, "k").select("id", "many"))
    assert plain(join_salted(rows, members, ["k"], F.xxhash64("id"), 5000, 4).select("id", "m")) == plain(rows.join(members, "k").select("id", "m"))
    scratch.drop()


# ---- 8 toxicity -------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    plain, bad = [f"w{i}" for i in range(300)], ["scoundrel", "villain", "rascal", "knave"]
    data = []
    for _ in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.15)
        for _ in range(rng.randint(2, 3) * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        data.append((" ".join(w), y))
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data) if i % 3], "doc_id bigint, quality int, toxic int")
    df = docs(spark, [t for t, _ in data])
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    held = [(r["predicted"], data[r["doc_id"]][1]) for r in rows if r["held_out"]]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.03 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_of_more_rows(spark):
    rng = random.Random(19)
    plain, bad = [f"w{i}" for i in range(300)], ["scoundrel", "villain", "rascal", "knave"]
    data = []
    for _ in range(3000):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.12)
        for _ in range(rng.randint(2, 3) * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        data.append((" ".join(w), y))
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, [t for t, _ in data])
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    held = [(r["predicted"], data[r["doc_id"]][1]) for r in rows if r["held_out"]]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.03 * len(held)


def test_toxicity_risk_and_gradient(spark):
    """Sums over Spark against the definition, and the gradient against differences."""
    import math

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, "", "w1 W1"]
    scratch = Scratch(spark, "risk")
    df = docs(spark, texts).select("text", (F.col("doc_id") % 3 == 0).alias("positive")).repartition(3)
    hashed = lambda w: int(_text.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(64 - toxicity.BITS))
    vocabulary = np.array(sorted(hashed(f"w{i}") for i in range(8)))
    n = {r["word"]: (r["n_p"], r["n_u"]) for r in toxicity._counts(df).collect()}
    assert n[-1] == (21, 63)
    own = [{hashed(w) for w in words(t)} for t in texts]
    for w in vocabulary:
        assert n[w] == (sum(w in x for i, x in enumerate(own) if i % 3 == 0), sum(w in x for x in own))
    risk = toxicity._unlabelled_risk(scratch.table(toxicity._sets(df, vocabulary), "sets"), 8)
    weights, bias = np.array([rng.uniform(-1, 1) for _ in range(8)]), 0.3
    at = lambda w, b: sum(math.log1p(math.exp(b + sum(w[k] for k in range(8) if vocabulary[k] in x))) for x in own)
    loss, grad, grad_b = risk(weights, bias)
    assert loss == pytest.approx(at(weights, bias))
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert grad[k] == pytest.approx((at(weights + step, bias) - at(weights - step, bias)) / 2e-5, abs=1e-5)
    assert grad_b == pytest.approx((at(weights, bias + 1e-5) - at(weights, bias - 1e-5)) / 2e-5, abs=1e-5)
    scratch.drop()


def test_toxicity_negative_risk_and_ties(spark):
    """A prior far above the truth makes the negatives' risk negative; steps then go back instead of diverging."""
    ids, offsets = np.array([0, 0, 0]), np.array([0, 1, 2, 3])
    unlabelled = np.concatenate([ids, np.zeros(0, int)]), np.array([0, 1, 2, 3, 3, 3, 3, 3, 3, 3])
    w, b = toxicity.descend((ids, offsets), lambda w, b: toxicity.losses(*unlabelled, w, b, -1.0), 9, 1, 0.9, steps=300)
    assert np.isfinite(w).all() and abs(w[0]) < 20 and abs(b) < 20
    assert toxicity.score(docs(spark, ["a", None]), toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)).where("score = 0.5 and predicted = 1").count() == 2


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd(spark), toxicity.fit(odd(spark), labels)).count() == 9
    assert toxicity.fit(odd(spark), labels.limit(0)) is None
    assert toxicity.score(empty(spark), None).count() == 0


# ---- 9 chat -------------------------------------------------------------------------------

ROLES = ["user", "assistant", "system", None, "x>y <s>"]
PARTS = ["</s>", "[INST]", "[/INST]", "<s>", "<a>", "<r:", "</r>", "\\", "<", "[", "é", "😀", " ", "\n", "/", "s>", "INST]", "a"]


def test_chat_round_trip(spark):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(ROLES), None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant", "x" * 5000) for t in range(600)] + [(None, 1, "user", "a"), (3, None, "user", "first"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df.withColumn("formatted", F.lit(1)))).collect()}
    by = {}
    null_first = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (null_first(r[1]), r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())):
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for c, own in by.items():
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_has_no_control_string_in_texts(spark):
    for control in chat.CONTROLS:
        text = chat.escape(f"\\{control.decode()}\\\\{control.decode()}")
        assert not any(c.decode() in text for c in chat.CONTROLS) and chat.unescape(text) == f"\\{control.decode()}\\\\{control.decode()}"
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_chat(df)).count() == 0


# ---- 10 decontamination -------------------------------------------------------------------------------


def item_words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(texts, items, window):
    out = []
    for t in texts:
        w, hit, found = item_words(t), set(), set()
        for k, item in items:
            own = item_words(item)
            n = min(window, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == own[a : a + n]:
                        hit |= set(range(i, i + n))
                        found.add(k)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most_broadcast", [100_000, 0])
def test_decontamination(spark, most_broadcast):
    rng = random.Random(11)
    vocab = ["A", "b", "c", "d", "é", "x1", "Zz"]
    phrase = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, phrase(rng.choice([0, 1, 2, 5, 12, 16]) if i > 3 else 14)) for i in range(18)] + [(3, "b"), (100, None), (7, "x1 x1 x1")]
    texts = [" ".join([phrase(rng.randint(0, 15)), rng.choice(items)[1] or "", phrase(3)]) for _ in range(60)] + [None, "", "...", "É é"]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontam.report(decontam.find(docs(spark, texts), frame, most_broadcast=most_broadcast)).collect()}
    for i, want in enumerate(brute_hits(texts, items, 10)):
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want and r["contaminated"] == (want[1] > 0)
    kept = decontam.drop_contaminated(docs(spark, texts), frame, most_broadcast=most_broadcast)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in rows if not rows[i]["contaminated"]}


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find(odd(spark), none).count() == 8  # the repeated row is one document
    items = spark.createDataFrame([(1, "a b"), (None, "c d")], "item_id bigint, text string")
    rows = decontam.report(decontam.find(odd(spark), items)).collect()
    assert len(rows) == 8 and {r["doc_id"] for r in rows if r["contaminated"]} == {5, 6, None}
    assert decontam.find(empty(spark), items).count() == 0
    assert decontam.drop_contaminated(odd(spark), items).count() == 5
    assert Scratch(spark, "t").path


def test_decontamination_filters_positions_before_a_shuffle(spark):
    texts = docs(spark, [" ".join(f"w{i * 7 % 501}" for i in range(j, j + 300)) for j in range(20)]).select("doc_id", F.xxhash64("text").alias("text_key"), decontam.words(F.col("text")).alias("w"))
    own = spark.createDataFrame([(1, f"w{i * 7 % 501} w{(i + 1) * 7 % 501} w{(i + 2) * 7 % 501} x") for i in range(9)], "item_id bigint, text string")
    tokens = decontam.shingles_of(decontam.windows_of(own, 10), 3).select(F.explode("tokens.hash").alias("hash")).distinct()
    n = tokens.count()
    filter_, high = decontam.shingle_filter(tokens, n)
    filter_ = Scratch(spark, "t").table(filter_, "filter")
    got = decontam._matched(texts, [3], filter_, high)
    exact = decontam._positions(texts, [3], outer=False).join(tokens, "hash", "left_semi").select("doc_id", "at")
    every = decontam._positions(texts, [3], outer=False).where("hash is not null").count()
    kept = {tuple(r) for r in got.select("doc_id", "at").collect()}
    assert {tuple(r) for r in exact.collect()} <= kept and len(kept) < exact.count() + 0.1 * every
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan
