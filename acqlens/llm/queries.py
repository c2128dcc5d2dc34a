"""The queries of this subpackage: thin digests of each operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.llm.common import id_crc, table
from acqlens.llm.oracles import ORACLES  # noqa: F401


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import secrets

    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import embeddings

    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import minhash

    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), params=minhash.MinHashParams(shingle=4))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import quality
    from acqlens.llm.common import stored

    stats = stored(quality.document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc-stats")
    learn = F.coalesce(id_crc() % 5 != 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(stats.where(learn).join(labels, "doc_id"))
    return quality.score(stats, model).select(
        "doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import langid

    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(id_crc() % 3 != 1, F.lit(False))
    model = langid.fit(docs.where(learn))
    return langid.predict(docs.select("doc_id", "text", (~learn).alias("held_out")), model).drop("text")


def op8_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import lm_score

    return lm_score.score(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import mixing

    rated, domains = mixing.document_rates(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", F.col("tokens_").alias("tokens"), F.col("rate_").alias("rate"),
                        *(F.col("posterior_")[k].alias(f"p_{d}") for k, d in enumerate(domains)))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import line_rules

    return line_rules.judge(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import spelling

    counts = spelling.word_counts(table(spark, sf_dir, "documents"), typo_mod=31)
    return spelling.variants(counts)


def op12_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import passages

    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acqlens.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bestfit_packing, op2_secret_scan, op3_suffix_dedup, op4_embedding_dedup, op5_minhash_dedup, op6_quality_qda,
        op7_language_id, op8_backoff_score, op9_source_mixing, op10_line_rules,
        op11_spelling_variants, op12_fm_index_dedup, op13_source_divergence)
}

