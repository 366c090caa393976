"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of documents; the last returns their piece ids.

Every stage handles null and empty texts, very long ones, ties, repeated rows, empty tables and
extra columns, also with clashing names, which pass through all but the last stage:

* quality_rules: a null or empty text fails the base rules and goes; repeated rows are judged alike.
* line_dedup: a null or blank text stays as it is; rows of equal doc_id and text are one document.
* near_duplicates: texts without words link with nothing and stay; rows of equal doc_id stay or
  go together; rows of a null doc_id are never spare.
* decontamination: texts without words stay; rows of equal doc_id and text are judged alike.
* sentencepiece: a null text has null ids, an empty one none.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontam, jaccard, linededup, pieces, quality
from waymark.llm._store import Scratch, bounded_batches, read

_open = threading.local()  # the scratch tables of the last stage that a thread began, by session


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Tables for one stage. Its predecessors' results are written by now, so theirs go."""
    bounded_batches(spark)
    own = _open.__dict__.setdefault("tables", {})
    if id(spark) in own:
        own.pop(id(spark)).drop()
    own[id(spark)] = Scratch(spark, name)
    return own[id(spark)]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    stats = _scratch(spark, "quality").table(quality.rule_statistics(docs), "stats")
    return quality.keep_good(docs, quality.fit(stats, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which no word is left by that."""
    out = linededup.dedup_lines(docs, scratch=_scratch(spark, "lines"))
    cut = F.size("removed_lines") > 0
    kept = out.where(~cut | linededup.has_word(F.col("text")))
    n_chars = F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles at 0.8 connect stays: the one of the smallest doc_id."""
    return jaccard.keep_first(docs, size=5, num=80, den=100, scratch=_scratch(spark, "jaccard"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), scratch=_scratch(spark, "decontam"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids of every document."""
    _scratch(spark, "pieces")
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.Vocabulary())
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The isolation forest and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs, tables = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        done = tables.table(stage(spark, docs, sf_dir), name)
        if i:
            tables.remove(STAGES[i - 1][0])
        docs = done
    _scratch(spark, "done")
    return docs
