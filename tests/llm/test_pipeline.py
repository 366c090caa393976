"""The pipeline against brute force on a whole small table."""

import pytest

pytest.importorskip("waymark.llm")
import corpus_pipeline  # noqa: E402
from test_operators import brute_components, brute_hits, brute_lines, brute_quality, words  # noqa: E402

from waymark.llm import pieces, quality  # noqa: E402


def test_pipeline(spark, sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stats = quality.rule_statistics(docs)
    forest = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.judge(stats, forest).where("kept").collect()}
    assert kept <= {i for i, t in text.items() if not brute_quality(t)[-1]}

    order = sorted(kept)
    lines = dict(zip(order, brute_lines([text[i] for i in order], 50)))
    lines = {i: t for i, t in lines.items() if t == text[i] or words(t)}
    order = sorted(lines)
    first = [i for k, (i, (_, c)) in enumerate(zip(order, brute_components([lines[i] for i in order], 5, 80, 100))) if c == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [i for i, hit in zip(first, brute_hits([lines[i] for i in first], items, 10)) if not hit[1]]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {i: model.encode(lines[i]) for i in clean}

    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).columns == docs.columns, name
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0


def test_stages_on_odd_input(spark, sf_dir):
    """Null, empty, blank, long and repeated texts, a null id, and columns named like the operators' own."""
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n "), (4, long), (5, "a b"), (5, "a b"), (6, "a b"), (None, "x y z w v u")]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, label int, n int, kept int, hit int"
    odd = spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, 7, 7, 7) for i, t in texts], kinds)
    stage = dict(corpus_pipeline.STAGES)

    def run(name):
        out = stage[name](spark, odd, sf_dir)
        assert out.columns == odd.columns
        rows = out.collect()
        assert all((r["key"], r["label"], r["n"], r["kept"], r["hit"]) == (7,) * 5 for r in rows)
        return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)

    assert {i for i, _ in run("quality_rules")} <= {4}
    assert run("line_dedup") == sorted(texts, key=repr)
    assert run("near_duplicates") == sorted((x for x in texts if x[0] != 6), key=repr)
    assert run("decontamination") == sorted(texts, key=repr)
    ids = [(r["doc_id"], r["ids"]) for r in stage["sentencepiece"](spark, odd, sf_dir).collect()]
    assert len(ids) == len(texts) and (1, None) in ids and (2, []) in ids and len(next(x for i, x in ids if i == 4)) > 30_000
