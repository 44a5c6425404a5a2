"""The registered queries: each runs one operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import (ann, bpe, classify, htmltext, kmeans, langid, lm, mixing, ngramjoin, periodic, quality, sharding,
               suffixdedup)
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = suffixdedup.remove_repeats(docs, "doc_id", "n_bytes")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          pattern or public_tokenizers.PATTERN, "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.with_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components_of(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = cut_lineage(quality.with_counts(table(spark, sf_dir, "documents"), "doc_id"), spark)
    out = quality.judge(counted, quality.fit(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "p_good")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    counts = langid.train(langid.sample(docs.where(~held_out)))
    out = langid.predict(docs.select("doc_id", "text"), counts, "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), langid.fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("page_id", "url", "text", "n_chars")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_tail(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic.with_runs(docs, "doc_id").withColumn("best", periodic.longest(F.col("runs")))
    length, period = -F.col("best.less"), F.col("best.period")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                      length.alias("length"), period.alias("period"),
                      F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    weights = classify.train(classify.sample(docs, labels))
    out = classify.score(docs, weights, "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "score", classify.predicted(F.col("score")).alias("predicted"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_sharding": op3_sharding,
    "op4_source_mixing": op4_source_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_quality_classifier": op13_quality_classifier,
}
