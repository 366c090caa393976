"""Blocked, living, bucketed and parted indexes: equal answers, and plans and reads that stay small."""

import random
import re

import pytest
from pyspark.sql import functions as F

from waymark import catalog, catalog_index
from waymark.operators import search
from waymark.plans import blocks, layout, live
from waymark.plans import gazetteer as g

PHRASES = "q_id bigint, v int, words array<string>, exact_words array<string>"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def strings(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "al", "beta", "be", "gamma", "ga", "delta", "alp", "b"]
    return spark.createDataFrame([(i, 1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(n)], "idx bigint, code bigint, text string")


def answers(df):
    return sorted(tuple(r) for r in df.select("q_id", "v", "idx", "level", "pos").collect())


ASKED = [(1, 0, ["al"], []), (2, 0, ["a", "b"], []), (3, 0, ["alp", "be"], []), (4, 0, ["al", "al"], []), (5, 0, ["be", "ga"], ["be"]), (6, 0, ["zeta"], []), (7, 0, ["b", "zeta"], []), (8, 1, ["delt"], ["delt"]), (9, 0, ["alpha", "beta", "g"], [])]


@pytest.mark.parametrize("span, limit, first", [(16, 5, 1), (64, 1024, 2)])
def test_blocks_answer_as_postings(spark, span, limit, first):
    index = search.Index.build(strings(spark, 700))
    own = index.scratch.keep(blocks.blocked(index.posting, span))
    assert own.where("n > " + str(span)).count() == 0 and own.where("low > high or size(ids) <> n").count() == 0
    phrases = spark.createDataFrame(ASKED, PHRASES)
    allowed = index.strings.where("code % 3 <> 0").select("code", "idx")
    assert answers(blocks.intersect(phrases, own, index.vocab, index.scratch, limit, first_spans=first)) == answers(search.intersect(phrases, index, limit=limit))
    assert answers(blocks.intersect(phrases, own, index.vocab, index.scratch, limit, allowed.select("idx"), first)) == answers(search.intersect(phrases, index, allowed, limit))


def test_a_frequent_phrase_reads_few_blocks(spark):
    own = spark.range(40_000).select(F.col("id").alias("idx"), F.col("id").alias("code"), F.lit("alpha beta").alias("text"))
    index = search.Index.build(own)
    cut = index.scratch.keep(blocks.blocked(index.posting, 256))
    phrases = spark.createDataFrame([(1, 0, ["alpha", "beta"], []), (2, 0, ["al", "be"], [])], PHRASES)
    trace = []
    got = blocks.intersect(phrases, cut, index.vocab, index.scratch, 1024, trace=trace)
    assert got.groupBy("q_id").agg(F.max("idx"), F.count("*")).orderBy("q_id").collect() == [(1, 1023, 1024), (2, 1023, 1024)]
    rows = sum(t.select(F.explode("ids")).count() for t in trace)
    assert rows <= 2 * 2 * (6 * 256) and cut.select(F.sum("n")).first()[0] > 300_000


def test_blocks_are_never_broadcast(spark, monkeypatch):
    index = search.Index.build(strings(spark, 300))
    own = index.scratch.keep(blocks.blocked(index.posting, 16))
    phrases = spark.createDataFrame(ASKED, PHRASES)
    tokens = index.scratch.keep(blocks._tokens(phrases, index.vocab))
    want = answers(search.intersect(phrases, index, limit=20))
    few = plan(blocks._drivers(tokens, own, True))
    assert "BuildLeft" in few and "BuildRight" not in few
    assert answers(blocks.intersect(phrases, own, index.vocab, index.scratch, 20, first_spans=1)) == want
    monkeypatch.setattr(blocks, "MOST_BROADCAST", 0)
    many = plan(blocks._drivers(tokens, own, True))
    assert "SortMergeJoin" in many and "BroadcastHashJoin" not in many
    assert answers(blocks.intersect(phrases, own, index.vocab, index.scratch, 20, first_spans=1)) == want


def test_deltas_answer_as_a_rebuild(spark, tmp_path):
    root = str(tmp_path / "index")
    base = strings(spark, 200)
    search.Index.build(base).save(root, "v1")
    state = {r["idx"]: (r["code"], r["text"]) for r in base.collect()}
    rng = random.Random(5)
    for step in range(3):
        changes = {rng.randrange(230): rng.choice([None, "alpha new", "be be be", "zeta"]) for _ in range(40)}
        rows = [(i, 1000 + i, t) for i, t in changes.items()]
        assert live.apply(spark, root, spark.createDataFrame(rows, "idx bigint, code bigint, text string")) == step + 1
        for i, c, t in rows:
            state.pop(i, None)
            if t is not None:
                state[i] = (c, t)
    whole = search.Index.build(spark.createDataFrame([(i, *v) for i, v in state.items()], base.schema))
    phrases = spark.createDataFrame(ASKED, PHRASES)
    for index in (live.load(spark, root), live.compact(spark, root, "v2")):
        assert answers(search.intersect(phrases, index)) == answers(search.intersect(phrases, whole))
        assert sorted(map(tuple, index.vocab.select("mult", "token", "n_exact", "n_approx").collect())) == sorted(map(tuple, whole.vocab.select("mult", "token", "n_exact", "n_approx").collect()))
        assert sorted(map(tuple, index.strings.select("idx", "code", "text").collect())) == sorted((i, *v) for i, v in state.items())
    assert live._deltas(spark, root, "v2") == [] and live._deltas(spark, root, "v1") == [1, 2, 3]


def test_half_a_delta_is_ignored(spark, tmp_path):
    root = str(tmp_path / "index")
    search.Index.build(strings(spark, 20)).save(root, "v1")
    changes = spark.createDataFrame([(1, 1, "zeta")], "idx bigint, code bigint, text string")
    changes.write.parquet(f"{root}/v1/deltas/1/strings")  # its writer was lost
    assert live.load(spark, root).vocab.where("token = 'zeta'").count() == 0
    assert live.apply(spark, root, changes) == 1
    assert live.load(spark, root).vocab.where("token = 'zeta'").first()["n_exact"] == 1


def test_a_lookup_shuffles_only_the_queries(spark, tmp_path):
    index = search.Index.build(strings(spark, 300))
    objects = index.strings.select("code", F.when(F.col("code") % 2 == 0, 106).otherwise(108).alias("typ"))
    layout.save(index, objects, str(tmp_path / "index"), "v1", buckets=4)
    own = layout.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["al", "be", "zeta", "delta"])], "q_id bigint, token string, mult int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.token_lookup(asked, own.posting)
        shown = plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"^\(\d+\) Exchange", shown, re.M)) == 1
    assert "Bucketed: true" in shown
    want = search.token_lookup(asked, index.posting).select("q_id", "idx", "exact")
    assert sorted(map(tuple, found.select("q_id", "idx", "exact").collect())) == sorted(map(tuple, want.collect()))


def test_only_big_objects_are_indexed(spark, sf_dir):
    index, names = catalog_index._big_index(spark, sf_dir)
    every = g.index_strings(catalog._paths(spark, sf_dir)).join(g.synthetic(spark, sf_dir).where(F.col("typ").isin(*g.BIG)).select("code"), "code", "left_semi")
    rows = lambda df: {(r["idx"], r["code"], r["text"]) for r in df.collect()}
    assert rows(index.strings) == rows(names) == rows(every)
    assert max(g.INDEX_ORDER[t] for t in g.BIG) < min(n for t, n in g.INDEX_ORDER.items() if t not in g.BIG)


def test_big_objects_are_read_alone(spark, sf_dir):
    index, _ = catalog_index._big_index(spark, sf_dir)
    assert re.search(r"PartitionFilters: \[[^\]]*big", plan(index.posting))
    typ = index.strings.join(index.posting.select("idx").distinct(), "idx").select((F.col("code") / 1_000_000).cast("int").alias("typ")).distinct()
    assert {r["typ"] for r in typ.collect()} == {105, 106, 113}


