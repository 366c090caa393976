"""The operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat, decontam, fim, hardneg, jaccard, linededup, lm, pieces, pii, quality, tokens, toxicity, urls
from waymark.llm._store import Scratch, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark, "op1").table(quality.rule_statistics(read(spark, sf_dir, "documents")), "stats")
    return quality.judge(stats, quality.fit(stats, read(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(read(spark, sf_dir, "documents"))
    more = F.transform("found", lambda s: F.concat(F.lit("id:"), s["first"].cast("string"), F.lit(":"), s["last"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), more), lambda x: x != ""), ",")
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size("found").cast("bigint").alias("n_id"))


# The contract's rules of op3.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, pieces.Vocabulary(), decoded="decoded")
    same = F.col("decoded") == F.translate("text", pieces.MARK, " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed_lines", F.lit(0).cast("bigint"), lambda s, r: s + (r["end_line"] - r["first_line"]))
    kept = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint")
    n_lines = F.when((F.col("text") == "") & (n_removed > 0), n_removed).otherwise(kept + n_removed)
    return out.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(rows))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    compiled = tokens.Compiled(str(public_tokenizers.path("byte_bpe_50k.json")))
    return tokens.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), compiled).drop("text")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.usable(read(spark, sf_dir, "embeddings"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lm_score": op6_lm_score,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_decontamination": op10_decontamination,
    "op11_token_counts": op11_token_counts,
    "op12_fim": op12_fim,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op3_url_filter": urls.sql(URL_RULES), "op4_jaccard_join": jaccard.sql(4, 85, 100), "op7_line_dedup": linededup.SQL, "op9_chat_format": chat.SQL, "op10_decontamination": decontam.SQL, "op12_fim": fim.SQL, "op13_hard_negatives": hardneg.SQL}
