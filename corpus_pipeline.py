"""Corpus preparation: documents to training mix, in five stages.

Each stage applies one operator of ``larder.llm`` with production parameters to
all that the stage before kept; its result is written as Parquet in the
session's shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontamination, langid, minhash, mixing, substring_dedup
from larder.llm.common import Scratch, table

# A document whose best language scores below this is rejected, as is one that is undetermined.
LEAST_LANGUAGE_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which some learned language is recognised."""
    model = langid.train(langid.training_rows(docs))
    # Asked for by other names, so a documents column called score survives.
    scored = langid.predict(docs.withColumnsRenamed({"score": "__score", "lang_pred": "__lang_pred"}), model)
    kept = scored.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"__score": "score", "__lang_pred": "lang_pred"})


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group (5-word shingles, 0.8)."""
    names = ("n_shingles", "component_id", "kept")
    aside = {n: f"__{n}" for n in names}
    found = minhash.near_duplicates(docs.withColumnsRenamed(aside))
    return found.where("kept").drop(*names).withColumnsRenamed({v: k for k, v in aside.items()})


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that 50-word windows repeat from earlier documents; a text that loses
    none keeps its white space, one that loses all goes."""
    names = ("n_words", "n_removed", "removed", "kept_text")
    aside = {n: f"__{n}" for n in names}
    cut = substring_dedup.drop_repeats(docs.withColumnsRenamed(aside))
    cut = cut.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.drop(*names).withColumnsRenamed({v: k for k, v in aside.items()})


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark passage."""
    aside = {n: f"__{n}" for n in ("matches", "n_words")}
    kept = decontamination.clean(docs.withColumnsRenamed(aside), table(spark, sf_dir, "benchmark"))
    return kept.withColumnsRenamed({v: k for k, v in aside.items()})


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, in random order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# Language ID is learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
