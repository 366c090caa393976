"""Plans that must hold at any size: no nested loops, narrow scans, filters in the scan, cut before dealing."""

import re

import pytest
from pyspark.sql import functions as F

from waymark import catalog, catalog_database, catalog_fetched, catalog_index, catalog_io, catalog_streams  # noqa: F401
from waymark.operators import search
from waymark.plans import index


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# Their steps are run while they are planned, and each is a join that another query here has.
PREPARED = {"refresh_stream", "version_refresh", "refresh_state", "late_subscribers", "resolve_batch", "fuzzy_search", "bounded_search", "split_tokens", "live_index_search", "live_vocabulary", "compacted_index_search", "saved_index_search", "bucketed_search"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in PREPARED and not n.startswith("database_")])
def test_no_nested_loops(spark, sf_dir, name):
    assert not re.search("CartesianProduct|NestedLoopJoin|PythonUDF|BatchEvalPython", plan(catalog.QUERIES[name](spark, sf_dir)))


def test_scans_are_narrow(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(catalog.QUERIES["normalize_tokens"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: (struct<c_[^>]*>)", plan(catalog.QUERIES["nearest_k"](spark, sf_dir)))) <= {"struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>"}


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[.*LessThan\(o_orderdate", plan(catalog.QUERIES["sync_apply_diff"](spark, sf_dir)))


def test_parents_are_broadcast_and_numbers_dealt_by_ranges(spark, sf_dir):
    assert "SortMergeJoin" not in plan(catalog.QUERIES["hierarchy_path"](spark, sf_dir))
    assert not re.search(r"Window \[[^\n]*partitionBy|hashpartitioning\((w|n)#", plan(catalog.QUERIES["index_order"](spark, sf_dir)))


def test_row_numbers_cut_early(spark):
    strings = spark.createDataFrame([(i, i, "a b" if i % 2 else "ab") for i in range(200)], "idx bigint, code bigint, text string")
    index = search.Index.build(strings)
    phrases = spark.createDataFrame([(1, 0, ["a"], [])], "q_id bigint, v int, words array<string>, exact_words array<string>")
    top = search.intersect(phrases, index, limit=5)
    assert "WindowGroupLimit" in plan(top) and "salt" in plan(top)
    assert [(r["idx"], r["level"], r["pos"]) for r in top.orderBy("pos").collect()] == [(i, 0, k) for k, i in enumerate((1, 3, 5, 7, 9))]
    assert search.intersect(phrases, index).where(F.col("level") == 1).count() == 100


def test_synonyms_are_sent_to_the_postings(spark, sf_dir, monkeypatch):
    strings = catalog._parts(spark, sf_dir)
    synonyms = spark.createDataFrame([("red", "crimson"), ("s", "small")], "word string, synonym string")
    few = index.postings(strings, synonyms)
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    monkeypatch.setattr(index, "MOST_BROADCAST", 1)
    many = index.postings(strings, synonyms)
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_prefix_totals_equal_the_counts(spark):
    rows = [(1, "ab abc ab b"), (2, "aa a"), (2, "ab x"), (3, None), (4, " , "), (None, "q qu"), (None, "q"), (5, "ē e \U0001f600x \U0001f600y \U0001f600"), (6, "one")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    totals = index.prefix_totals(texts, "doc_id")
    want = index.prefix_counts(texts, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_prefixes"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.max("n").alias("most"))
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, totals.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
