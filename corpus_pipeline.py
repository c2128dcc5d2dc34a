"""Corpus pipeline: language, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next stage's ``docs``.  All but the last return the columns of ``docs``; the last
returns the packed pieces.  There is no SQL for the whole: a trained language model, a trained
domain model and bin packing have none, so the stages are tested one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.llm import langid, minhash, mixing, packing, secrets
from acqlens.llm.common import fresh, id_crc, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the model learns from the labelled rows."""
    model = langid.fit(docs.where(F.coalesce(id_crc() % 3 != 1, F.lit(False))))
    name, score = fresh("lang_pred", docs), fresh("lang_score", docs)
    scored = langid.predict(docs, model, name_col=name, score_col=score)
    return scored.where((F.col(name) != langid.UNDETERMINED) & (F.col(score) >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mark; the character count follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that expected domain tokens match the weights."""
    return mixing.sample_by_rate(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
