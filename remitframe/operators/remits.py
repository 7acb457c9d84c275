"""Remittance (835) segments -> remittances, adjustments and remark codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.functions.edi import adjustment_entries, as_of, entity_id, safe_decimal
from remitframe.operators.claims import element, of_family, with_late


def remittance_rows(annotated: DataFrame) -> DataFrame:
    """Good CLP segments, dated by the last DTM*050 before them (``remit_day``) and the last one inside
    them (``override``)."""
    paid = safe_decimal(element(4))
    return of_family(annotated, "CLP").where("clp_ok").select(
        "upload_seq", "seg_pos", "remittance_claim_id", element(1).alias("claim_number"),
        element(2).alias("claim_status_code"), safe_decimal(element(3)).alias("billed_amount"),
        F.coalesce(paid, F.lit(0).cast("decimal(12,2)")).alias("paid_amount"),
        F.nullif(element(7), F.lit("")).alias("payer_claim_control_number"), "remit_day",
        F.col("own_remit_day").alias("override"),
        F.col("raw_segment_text").alias("raw_clp_segment"))


def remittances(annotated: DataFrame, late: DataFrame,
                as_of_date: str | None = None) -> DataFrame:
    rows = with_late(remittance_rows(annotated), late, "remit", "override", "day")
    return rows.withColumn("remittance_date",
                           F.coalesce("override", "remit_day", as_of(as_of_date))
                           ).drop("override", "remit_day", "seg_pos")


def adjustments(annotated: DataFrame) -> DataFrame:
    """Numbered by triplet within the segment."""
    return of_family(annotated, "CAS").where(
        F.col("remittance_claim_id").isNotNull() & (element(1) != "")).select(
        "upload_seq", "remittance_claim_id", F.col("seg_pos").alias("segment_position"),
        element(1).alias("adjustment_group_code"),
        F.col("raw_segment_text").alias("raw_cas_segment"),
        F.posexplode(adjustment_entries(F.col("elements"))).alias("i", "a")).select(
        "upload_seq", "remittance_claim_id", "segment_position",
        (F.col("i") + 1).alias("ordinal"), "adjustment_group_code",
        F.col("a.reason").alias("adjustment_reason_code"),
        safe_decimal(F.col("a.amount")).alias("adjustment_amount"), "raw_cas_segment")


def remark_codes(annotated: DataFrame) -> DataFrame:
    code = F.coalesce(F.nullif(element(2), F.lit("")), F.nullif(element(1), F.lit("")))
    return of_family(annotated, "LQ").where(F.col("remittance_claim_id").isNotNull()).select(
        "upload_seq", entity_id(F.col("upload_seq"), F.col("seg_pos")).alias("remark_id"),
        "remittance_claim_id", code.alias("remark_code"),
        F.col("raw_segment_text").alias("raw_lq_segment")).where("remark_code is not null")
