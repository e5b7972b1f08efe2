"""Registered queries of the training-data operators: each applies one operator
with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (decontamination, divergence, embedding_dedup, langid, lm_scoring, minhash, mixing, quality,
                        substring_dedup, token_counts, url_filter, warc, whitening)
from larder.llm.common import Scratch, id_crc, table
from larder.llm.sql import SQL

# The rules of the URL filter, and the mark of links that a feed has spread.
URL_RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
             url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
SPREAD_LINK = "utm_source="

QUALITY_CUT = 0.3


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after its personal data is replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, edits_of=token_counts.redactions, carry=["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_matches(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.summary(found, ["doc_id"]).drop("matches")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), train_when=id_crc("doc_id", 5) != 0)
    scored = quality.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_documents(docs, id_crc("doc_id", 7) == 2)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups on 3-word shingles at 85 per cent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle=3, similarity=85, carry=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at equal weight, output as large as the input, in random order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", "text", "copy", "shuffle_key")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.training_rows(docs.where(id_crc("doc_id", 4) != 2)))
    return langid.predict(docs, model, carry=["doc_id"]).select(
        "doc_id", (id_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page; the list holds the canonical URLs of links that a feed has spread, so the same
    page under another scheme, host prefix, ending or query is found only through filter and join."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.url_parts(F.col("url"))
    listed = pages.where(F.col("url").contains(SPREAD_LINK)).select(url_filter.canonical(host, path).alias("canonical"))
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of vectors with equal labels."""
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that windows of 50 repeat from earlier documents, removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of every vector along the eight leading components, at variance one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).select("vec_id", "component", "n", "deviation", "whitened", "explained",
                                            "identity_error")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's payload after writing all pages to web archives and reading them back."""
    scratch = Scratch(spark)
    pages = table(spark, sf_dir, "pages")
    found = warc.read_archives(spark, warc.write_archives(pages, f"{scratch.root}/archives"))
    number = pages.schema["page_id"].dataType
    return warc.resolve_revisits(found, scratch).select(
        F.col("page_id").cast(number).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(number).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_decontamination, op3_quality, op4_lm_scoring, op5_near_dedup, op6_mixing,
        op7_language_id, op8_url_filter, op9_embedding_dedup, op10_substring_dedup, op11_divergence, op12_whitening,
        op13_warc)}

ORACLE_SQL: dict[str, str] = SQL
