import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import search
from waymark.plans import index as plan

F1 = ["aknas", "akls", "ak ak", "aknīste", "ak aknīste", "aka aka", "aka akācijas", "21 215"]
F2 = [*F1, "ventspils", "vencīši", "venskalni", "ventilācijas", "kazdanga", "ķirši", "ķiršu", "ķirša", "rīga", "brīvības", "brīvības rīga", "brīvības iela rīga", "brīvības valka", "brīvības iela valka", "brīvības iela 2 valka", "valles vidusskola, valle"]


def strings(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "idx bigint, code bigint, text string")


@pytest.fixture(scope="module")
def index(spark):
    return search.Index.build(strings(spark, F2))


def test_normalize(spark):
    df = spark.createDataFrame([("Brīvības iela 2-5, Rīga",), ("ŌÖ 'x'\n\"y\"",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()] == [["brivibas", "iela", "2", "5", "riga"], ["ōö", "x", "y"], [], []]


def test_search_stats(spark):
    words = text.normalize(F.lit("Valles vidusskola Valle Valles pag Vecumnieku nov"))
    got = spark.range(1).select(F.transform(text.search_stats(words), lambda s: s["n"])).first()[0]
    assert got == [1, 1, 3, 2, 1, 1, 1]


def test_prefix_counts(spark):
    rows = plan.postings(strings(spark, ["Valles vidusskola, Valle, Valles pag., Vecumnieku nov."])).groupBy("token").agg(F.max("mult").alias("n")).collect()
    got = {r["token"]: r["n"] for r in rows}
    assert len(got) == 30
    want = {"v": 5, "va": 3, "val": 3, "vall": 3, "valle": 3, "valles": 2, "vidusskola": 1, "pag": 1, "nov": 1, "vecumnieku": 1}
    assert {k: got[k] for k in want} == want


def test_index_statistics_and_checks(spark):
    posting = plan.postings(strings(spark, F1))
    assert sorted(map(tuple, plan.statistics(posting).collect())) == [(1, 20, 39), (2, 5, 12)]
    assert plan.invalid(posting).count() == 0


@pytest.mark.parametrize(
    "token, mult, want",
    [
        ("ak", 1, ["ak ak", "ak aknīste", "aknas", "akls", "aknīste", "aka aka", "aka akācijas"]),
        ("ak", 2, ["ak ak", "ak aknīste", "aka aka", "aka akācijas"]),
        ("akna", 1, ["aknas"]),
        ("aknass", 1, []),
        ("ziz", 1, []),
    ],
)
def test_token_lookup(spark, index, token, mult, want):
    asked = spark.createDataFrame([(0, token, mult)], "q_id bigint, token string, mult int")
    rows = search.token_lookup(asked, index.posting).where(F.length("token") > 0).orderBy(F.desc("exact"), "idx").collect()
    assert [F2[r["idx"]] for r in rows if r["idx"] < len(F1) or token not in ("ak",)] == want


# Word, allowed edits, and the (strings, distance) that must be found.
FUZZY = [
    ("aka", 1, [(["aka aka", "aka akācijas"], 0), (["ak ak", "ak aknīste"], 1)]),
    ("akācijas", 1, [(["aka akācijas"], 0)]),
    ("akcijas", 1, [(["aka akācijas"], 1)]),
    ("akucijas", 1, [(["aka akācijas"], 1)]),
    ("akaicijas", 1, [(["aka akācijas"], 1)]),
    ("kakācijas", 1, [(["aka akācijas"], 1)]),
    ("ukācijas", 1, [(["aka akācijas"], 1)]),
    ("akācijs", 1, [(["aka akācijas"], 1)]),
    ("akācijaz", 1, [(["aka akācijas"], 1)]),
    ("akācijass", 1, [(["aka akācijas"], 1)]),
    ("aklas", 1, [(["akls"], 1), (["aknas"], 1)]),
    ("kakls", 1, [(["akls"], 1)]),
    ("ventspils", 1, [(["ventspils"], 0)]),
    ("venspils", 1, [(["ventspils"], 1)]),
    ("vencpils", 1, []),
    ("kaklas", 1, []),
    ("ventpils", 1, [(["ventspils"], 1)]),
    ("venpils", 1, []),
    ("bazdanga", 1, [(["kazdanga"], 1)]),
    ("bentspils", 1, [(["ventspils"], 1)]),
    ("vazdanga", 1, [(["kazdanga"], 1)]),
    ("kentspils", 1, [(["ventspils"], 1)]),
    ("kirsa", 1, [(["ķirša"], 0), (["ķiršu"], 1), (["ķirši"], 1)]),
    ("akliss", 2, [(["akls"], 2)]),
    ("kaklas", 2, [(["akls"], 2), (["aknas"], 2)]),
    ("kikls", 2, [(["akls"], 2)]),
    ("kakliss", 2, []),
    ("ventpils", 2, [(["ventspils"], 1)]),
    ("venpils", 2, [(["ventspils"], 2)]),
    ("vencpils", 2, [(["ventspils"], 2)]),
    ("sbazdanga", 2, [(["kazdanga"], 2)]),
    ("kazdangazi", 2, [(["kazdanga"], 2)]),
]


def test_fuzzy_tokens(spark, index):
    asked = spark.createDataFrame([(i, t, most) for i, (t, most, _) in enumerate(FUZZY)] + [(99, "vallez", 1)], "q_id bigint, t string, most int")
    asked = asked.select("q_id", text.normalize(F.col("t"))[0].alias("token"), F.when(F.col("q_id") == 99, 2).otherwise(1).alias("mult"), "most")
    near = search.fuzzy_tokens(asked.select("token", "mult", "most"), index.vocab)
    whole = index.posting.groupBy("token", "mult").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("idx")))).alias("e"), F.sort_array(F.collect_set("idx")).alias("a"))
    rows = asked.join(near.distinct(), ["token", "mult"]).where("edit_distance <= most").join(whole.withColumnRenamed("token", "word"), ["word", "mult"]).collect()
    for i, (token, _, want) in enumerate(FUZZY):
        got = {(tuple(F2[k] for k in (r["e"] or r["a"])), r["edit_distance"]) for r in rows if r["q_id"] == i}
        assert got == {(tuple(strings), distance) for strings, distance in want}, token
    assert [(F2[r["e"][0]], r["edit_distance"]) for r in rows if r["q_id"] == 99] == [("valles vidusskola, valle", 1)]


# Word, allowed edits, and the (distance, splits, strings) that must be found.
SPLIT = {
    ("rigabrivibas", 0): {(1, 1, ("brīvības rīga", "brīvības iela rīga"))},
    ("riiabrvbas", 2): {(4, 1, ("brīvības rīga", "brīvības iela rīga"))},
    ("riiabriv", 2): {(2, 1, ("brīvības rīga", "brīvības iela rīga"))},
    ("riiabrivi", 2): {(2, 1, ("brīvības rīga", "brīvības iela rīga"))},
    ("riiaie", 2): {(2, 1, ("brīvības iela rīga",))},
    ("riiabrivibasiela", 2): {(3, 2, ("brīvības iela rīga",))},
    ("brvbasiela", 2): {(3, 1, ("brīvības iela rīga", "brīvības iela valka", "brīvības iela 2 valka"))},
    ("riiabrvbasiela", 2): {(5, 2, ("brīvības iela rīga",))},
    ("riiaielabrvbas", 2): {(5, 2, ("brīvības iela rīga",))},
    ("vlkabrvbasiela", 2): {(5, 2, ("brīvības iela valka", "brīvības iela 2 valka"))},
    ("brvbasiela2valka", 2): {(5, 3, ("brīvības iela 2 valka",)), (5, 2, ("brīvības iela valka", "brīvības iela 2 valka"))},
}


def plain(t):
    return [w for w in t.translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO)).replace(",", " ").split()]


def test_split_tokens(spark, index):
    asked = spark.createDataFrame([(t, 1, m) for t, m in SPLIT], "token string, mult int, most int")
    rows = search.split_tokens(asked, index).collect()
    for (token, _), want in SPLIT.items():
        own = [r for r in rows if r["token"] == token]
        assert {(r["edit_distance"], r["splits"], r["n_refs"]) for r in own} == {(e, s, len(x)) for e, s, x in want}, token
        for r in own:  # all words of a reading, the last one perhaps as a prefix
            having = lambda t: all(any(w == x or (w == r["words"][-1] and x.startswith(w)) for x in plain(t)) for w in r["words"])  # noqa: B023, E731
            assert {t for t in F2 if having(t)} >= set().union(*[x for e, n, x in want if (e, n) == (r["edit_distance"], r["splits"])]), token


def run(spark, index, *texts):
    asked = spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")
    ranked = index.strings.select("code", F.array(text.normalize(F.col("text"))).alias("written"), F.lit(None).cast("array<array<string>>").alias("past"))
    out = {t: [] for t in texts}
    for r in search.search(asked, index, ranked).orderBy("q_id", "place").collect():
        out[texts[r["q_id"]]].append((F2[r["code"]], r["edit_distance"]))
    return out


def test_search(spark, index):
    got = run(spark, index, "ak nas", "a k n a s", "vallez vallez", "briv rig", "rigga brivibas", "", "rigabrivibas")
    assert got["ak nas"] == [("aknas", 1)]
    assert got["a k n a s"] == [("aknas", 4)]
    assert got["vallez vallez"] == [("valles vidusskola, valle", 1)]
    assert {x for x, _ in got["briv rig"]} == {"brīvības rīga", "brīvības iela rīga"}
    assert {x for x, _ in got["rigga brivibas"]} == {"brīvības rīga", "brīvības iela rīga"} and got["rigga brivibas"][0][1] == 1
    assert got[""] == []
    assert got["rigabrivibas"] == [("brīvības rīga", 1), ("brīvības iela rīga", 1)]


def test_fuzzy_search_tries_corrections_after_the_32nd(spark):
    # 40 words are two edits from the first word asked; only the last in order shares a string with the second.
    near = [f"kalnap{c}{d}" for c in "abcdefgh" for d in "abcde"]
    own = search.Index.build(strings(spark, [*(f"{w} jurmala" for w in near[:-1]), f"{near[-1]} valmiera"]))
    asked = spark.createDataFrame([(0, "kalnapzz valmeira")], "q_id bigint, text string")
    asked = asked.select("q_id", text.normalize(F.col("text")).alias("words"))
    found = search.fuzzy_search(asked, own).join(own.strings, "idx").collect()
    assert [r["text"] for r in found] == [f"{near[-1]} valmiera"]


def brute_rank(words, written, past):
    n = min(len(words), 32)

    def count(state, names):
        i, seq, whole = state
        for name in names:
            if i >= n:
                break
            if name.startswith(words[i]):
                whole += len(name) == len(words[i])
                seq, i = seq + 1, i + 1
            else:
                seq -= 1
        return i, max(seq, 0), whole

    state = (0, 0, 0)
    for names in written:
        if state[0] >= n:
            break
        state = count(state, names)
    score = lambda s: (n - s[1]) << 5 | (n - s[2])
    return min([score(state), *(score(count((0, 0, 0), p)) for p in past or [])])


def test_rank(spark):
    cases = [
        (["riga", "brivibas", "2"], [["brivibas", "iela"], ["2"], ["riga"]], None),
        (["brivibas", "2", "riga"], [["brivibas", "iela"], ["2"], ["riga"]], None),
        (["briv", "ie", "2", "ri"], [["brivibas", "iela"], ["2"], ["riga"]], [["briv", "ie", "2", "ri"]]),
        (["x"], [["a", "b"], ["x"]], [["x", "y"]]),
        ([], [["a"]], None),
    ]
    df = spark.createDataFrame(cases, "w array<string>, written array<array<string>>, past array<array<string>>")
    assert [r[0] for r in df.select(search.rank(F.col("w"), F.col("written"), F.col("past"))).collect()] == [brute_rank(*c) for c in cases]


def test_synonyms(spark):
    posting = plan.postings(strings(spark, ["bulvāris daugavpils"]), spark.createDataFrame([("daugavpils", "dpils")], "word string, synonym string"))
    got = {(r["token"], r["exact"]) for r in posting.collect()}
    assert {("dp", True), ("dpils", True), ("d", True), ("d", False)} <= got


def test_token_bounds(spark):
    df = spark.createDataFrame([("12", 1), ("ab", 1), ("abc", 1), ("abcdef", 1), ("215", 2), ("123456", 1)], "t string, m int")
    assert [r[0] for r in df.select(text.token_edit_distance(F.col("t"), F.col("m"))).collect()] == [0, 0, 1, 2, 1, 0]


def test_a_token_of_equal_letters_does_not_multiply(spark):
    """Readings that differ in their words' order alone go on as one."""
    strings = spark.createDataFrame([(0, 0, "a aa aaa")], "idx bigint, code bigint, text string")
    index = search.Index.build(strings)
    rows = {}
    for n in (6, 10):
        asked = spark.createDataFrame([("a" * n, 1, 2)], "token string, mult int, most int")
        rows[n] = search.split_tokens(asked, index).select("words", "edit_distance").collect()
    assert len(rows[6]) < 54 and len(rows[10]) < 400
    assert min(r["edit_distance"] for r in rows[6]) == 1 and ["aaa", "aaa"] in [r["words"] for r in rows[6]]
