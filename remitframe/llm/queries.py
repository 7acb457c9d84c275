"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.llm import (
    best_fit, exact_dedup, fill_middle, filter_audit, html_text, line_dedup, mixing, near_dup,
    packing, quality, secret_scan, suffix_dedup, warc_zip)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return line_dedup.drop_boilerplate(documents(spark, sf_dir).select(
        "doc_id", "source", "text"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                        "base_sha256", secret_scan.joined_spans().alias("spans"), "n_checked")


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the public byte-level vocabulary."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"))


# The tree of the mixture: three domains of sources, and what each level's nodes weigh.
DOMAIN_WEIGHTS = (3, 2, 1)
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def mixture_levels() -> dict[str, F.Column]:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.when(number == "", 0).otherwise(F.expr(
        "try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as decimal(38,0)) % 3"))
    return {"domain": F.coalesce(domain.cast("int"), F.lit(0)), "lang": F.col("lang"),
            "source": F.col("source")}


def mixture_weights() -> dict[str, F.Column]:
    domain = F.col("domain")
    lang = F.lit(1)
    for name, weight in LANG_WEIGHTS.items():
        lang = F.when(F.col("lang") == name, weight).otherwise(lang)
    return {"domain": F.when(domain == "0", DOMAIN_WEIGHTS[0]).when(
        domain == "1", DOMAIN_WEIGHTS[1]).otherwise(DOMAIN_WEIGHTS[2]), "lang": lang}


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "class_id", "copy_of", "n_links")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture of three quarters of all tokens holds each document."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", mixing.estimated_tokens().alias("size"))
    return mixing.mix(docs, mixture_levels(), mixture_weights(), tokens=F.col("size")).drop("size")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), (F.length("kept") + spans).alias("n_bytes"),
        spans.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed(
        "id", "page_id")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few sequences of at most 2048 tokens, with the public word vocabulary."""
    import public_tokenizers
    return best_fit.pack_best_fit(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed(
        "id", "doc_id")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts in their new order, and of the texts rebuilt from them."""
    return fill_middle.fill_middle(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir),
                              spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_secrets": op2_secrets,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_near_dup": op6_near_dup,
        "op7_mixing": op7_mixing,
        "op8_warc": op8_warc,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_html": op10_html,
        "op11_best_fit": op11_best_fit,
        "op12_fill_middle": op12_fill_middle,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    from remitframe.llm import oracle   # it takes the mixture's weights from here
    return oracle.oracle_sql()
