"""The corpus pipeline: from ``documents`` to packed sequences, stage by stage.

Each stage takes what its predecessor kept, and its result is written and read again before the
next one runs. Rows with null or repeated ids, null or empty texts and null sources pass through
like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.llm import line_dedup, mixing, near_dup, quality, queries
from remitframe.llm.common import staged, with_key
from remitframe.session import checked_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Of what is left by then, the mixture may take so much. Documents are taken once.
BUDGET_SHARE = 0.9
# Dropped rows that may be sent to every task, at most some hundred bytes each; beyond that they
# meet the documents in a shuffle.
BROADCAST_DROPPED = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or are far from their language."""
    # The verdict follows from these three; texts are neither moved nor written a second time.
    key = {"doc_id": F.col("doc_id"), "lang": F.col("lang"),
           "digest": F.sha2(F.coalesce("text", F.lit("")), 256)}
    judged = quality.judge(docs, carried=F.struct(*[c.alias(n) for n, c in key.items()]))
    dropped = staged(judged.where("not kept").select("carried.*").distinct(), "dropped")
    same = [c.eqNullSafe(dropped[n]) for n, c in (
        ("doc_id", docs["doc_id"]), ("lang", docs["lang"]),
        ("digest", F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))]
    return checked_join(docs, dropped, same, "left_anti", BROADCAST_DROPPED).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines; all documents stay."""
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when(
        F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    keyed = with_key(docs.select(*COLUMNS), "doc_id", "text",
                     [F.struct(*COLUMNS).alias("row")])
    found = near_dup.near_duplicates(keyed.select("doc", "text"), id_col="doc")
    dropped = staged(found.where("not stays").select(F.col("id").alias("doc")), "dropped")
    return checked_join(keyed.select("doc", "row"), dropped, "doc", "left_anti",
                        BROADCAST_DROPPED).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture takes."""
    mixed = mixing.mix(docs.select(*COLUMNS), queries.mixture_levels(),
                       queries.mixture_weights(), budget_share=BUDGET_SHARE, max_epochs=1)
    return mixed.where("copies > 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return queries.packed(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                       "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage),
          ("near duplicates", near_dup_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]
# Near duplicates, hashes and token ids are not for SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
