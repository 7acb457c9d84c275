"""Submission (837) segments -> claims, service lines and diagnoses.

Input is the annotated segment frame of ``scan.apply_carry``; every entity already knows its
owner, number and date, so claims, lines and diagnoses need no shuffle. ``late`` holds the few facts that
come in a later chunk than their owner (``late_facts``); it is broadcast while it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.functions.edi import (
    as_of, diagnosis_entries, entity_id, is_zero, safe_date, safe_decimal, safe_element,
    split_composite,
)


def of_family(annotated: DataFrame, family: str) -> DataFrame:
    """Segments of one family. Prunes the scan to that family's folder."""
    return annotated.where(F.col("family") == family)


def element(i: int):
    return safe_element(F.col("elements"), i)


def late_facts(annotated: DataFrame) -> DataFrame:
    """Dates and control numbers of owners in an earlier chunk: ``upload_seq, kind, target, day,
    control_no``, the last one of each kind per owner, so at most a few rows a chunk.

    A DTP*472 belongs to the last good CLM, HI or SV1 before it: after CLM or HI it dates the open
    claim, after SV1 that line. A REF*F8 belongs to the open claim, a DTM*050 to the open remittance.
    """
    nothing = F.lit(None)

    def of_kind(family, kind, target, day, control_no):
        return of_family(annotated, family).where("loose").select(
            "upload_seq", F.lit(kind).alias("kind"), target.alias("target"), "seg_pos",
            day.cast("date").alias("day"), control_no.cast("string").alias("control_no"))
    served = F.when(F.col("owner") == "SV1", F.col("owner_pos")).otherwise(F.col("claim_pos"))
    loose = of_kind("DTP", "service", F.when(F.col("owner").isNotNull(), served),
                    safe_date(element(3)), nothing).unionByName(
        of_kind("REF", "control", F.col("claim_pos"), nothing, element(2))).unionByName(
        of_kind("DTM", "remit", F.col("remit_pos"), safe_date(element(2)), nothing))
    last = F.max_by(F.struct("day", "control_no"), "seg_pos").alias("last")
    return loose.where("target is not null").groupBy("upload_seq", "kind", "target").agg(
        last).select("upload_seq", "kind", "target", "last.*")


def with_late(rows: DataFrame, late: DataFrame, kind: str, column: str, late_column: str) -> DataFrame:
    """``column`` with what a later chunk says, which is the last word."""
    side = late.where(F.col("kind") == kind).select(
        "upload_seq", F.col("target").alias("seg_pos"), F.col(late_column).alias("_late"))
    return rows.join(side, ["upload_seq", "seg_pos"], "left").withColumn(
        column, F.coalesce("_late", column)).drop("_late")


def claim_rows(annotated: DataFrame, late: DataFrame) -> DataFrame:
    """Good CLM segments as claims."""
    parts = split_composite(element(5), F.col("component_sep"))
    rows = of_family(annotated, "CLM").where("clm_ok").select(
        "upload_seq", "seg_pos", "claim_id", element(1).alias("claim_number"),
        "payer_name", "patient_member_id",
        safe_decimal(element(2)).alias("total_charge_amount"),
        F.get(parts, F.lit(0)).alias("facility_type_code"),
        F.get(parts, F.lit(2)).alias("frequency_code"),
        F.col("own_day").alias("service_date"),
        F.col("own_control").alias("previous_payer_claim_control_no"),
        F.col("raw_segment_text").alias("raw_claim_segment"))
    return with_late(with_late(rows, late, "service", "service_date", "day"), late, "control",
                     "previous_payer_claim_control_no", "control_no")


def claims_837(annotated: DataFrame, late: DataFrame, as_of_date: str | None = None) -> DataFrame:
    return claim_rows(annotated, late).select(
        "*", F.coalesce("service_date", as_of(as_of_date)).alias("service_from_date"),
        F.col("service_date").alias("service_to_date"),
        F.lit(False).alias("is_placeholder")).drop("service_date", "seg_pos")


def line_rows(annotated: DataFrame) -> DataFrame:
    parts, units = F.col("_parts"), F.col("_units")

    def modifier(i):
        return F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    # No number and zero both mean one unit; a number too big rejects the file elsewhere.
    billed = F.coalesce(F.when((units != 0) | ~is_zero(element(4)), units),
                        F.lit(1).cast("decimal(10,2)"))
    # Columns of their own, so that each is split or read once.
    lines = of_family(annotated, "SV1").where("sv1_ok").withColumns({
        "_parts": split_composite(element(1), F.col("component_sep")),
        "_units": safe_decimal(element(4), 10, 2)})
    return lines.select(
        "upload_seq", "seg_pos", entity_id(F.col("upload_seq"), F.col("seg_pos")).alias("line_id"),
        "claim_id", "line_number", F.get(parts, F.lit(1)).alias("procedure_code"),
        modifier(2).alias("modifier1"), modifier(3).alias("modifier2"),
        billed.alias("units"),
        safe_decimal(element(2)).alias("billed_amount"),
        F.nullif(element(5), F.lit("")).alias("place_of_service"),
        F.col("own_day").alias("service_date"),
        F.col("raw_segment_text").alias("raw_sv1_segment"))


def claim_lines(annotated: DataFrame, late: DataFrame) -> DataFrame:
    return with_late(line_rows(annotated), late, "service", "service_date", "day").drop("seg_pos")


def diagnoses(annotated: DataFrame) -> DataFrame:
    """Numbered within the claim across its HI segments."""
    entries = diagnosis_entries(F.col("elements"), F.col("component_sep"))
    return of_family(annotated, "HI").where("claim_id is not null").select(
        "upload_seq", "claim_id", "dx_before", F.col("raw_segment_text").alias("raw_hi_segment"),
        F.posexplode(entries).alias("i", "dx")).select(
        "upload_seq", "claim_id", (F.col("dx_before") + F.col("i") + 1).cast("int")
        .alias("sequence_number"), "dx.diagnosis_code", "dx.diagnosis_type", "raw_hi_segment")
