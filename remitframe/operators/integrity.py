"""Which files the relational rules accept. One bad row rejects its whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.contracts import WIDTHS
from remitframe.functions.edi import (
    adjustment_entries, diagnosis_entries, is_zero, overflows, split_composite,
)
from remitframe.operators.claims import claim_rows, element, of_family


def _wide(table: str, column: str, text: Column) -> Column:
    width = WIDTHS[table][column]
    return F.when(F.length(text) > width, F.lit(f"value too long for {table}.{column}({width})"))


def _big(what: str, text: Column, precision: int = 12) -> Column:
    return F.when(overflows(text, precision, 2), F.lit(f"numeric overflow in {what}"))


def with_row_rules(segments: DataFrame) -> DataFrame:
    """Add the rule a segment breaks, found while its elements are at hand.

    ``raw_rule`` holds for the segment as such, ``row_rule`` for the row made from it, if one is
    made. Both are almost always null, so a later filter on them skips nearly all stored data.
    """
    raw = F.coalesce(_wide("raw_segments", "segment_name", F.col("segment_name")),
                     F.when(F.contains(F.col("raw_segment_text"), F.lit("\0")),
                            F.lit("text holds a NUL character")))
    # Split once per segment, as the rules look at the parts several times.
    name, sep = F.col("segment_name"), F.col("component_sep")
    split = segments.withColumns({
        "_parts": F.when(name == "SV1", split_composite(element(1), sep)).when(
            name == "CLM", split_composite(element(5), sep)),
        "_dx": F.when(name == "HI", diagnosis_entries(F.col("elements"), sep)),
        "_cas": F.when(name == "CAS", adjustment_entries(F.col("elements")))})
    return split.withColumns({"raw_rule": raw, "row_rule": _row_rule()}).drop(
        "_parts", "_dx", "_cas")


def _row_rule() -> Column:
    name = F.col("segment_name")
    parts = service = F.col("_parts")
    dx, cas = F.col("_dx"), F.col("_cas")

    def any_wide(entries, table, column, field):
        width = WIDTHS[table][column]
        return F.when(F.exists(entries, lambda x: F.length(x[field]) > width),
                      F.lit(f"value too long for {table}.{column}({width})"))
    claim = F.coalesce(
        _wide("claims", "claim_number", element(1)),
        _wide("claims", "facility_type_code", F.get(parts, F.lit(0))),
        _wide("claims", "frequency_code", F.get(parts, F.lit(2))),
        _big("claims.total_charge_amount", element(2)))
    line = F.coalesce(
        _wide("claim_lines", "procedure_code", F.get(service, F.lit(1))),
        _wide("claim_lines", "modifier1", F.get(service, F.lit(2))),
        _wide("claim_lines", "modifier2", F.get(service, F.lit(3))),
        _wide("claim_lines", "place_of_service", element(5)),
        _big("claim_lines.billed_amount", element(2)),
        F.when(overflows(element(4), 10, 2) & ~is_zero(element(4)),
               F.lit("numeric overflow in claim_lines.units")))
    payment = F.coalesce(
        _wide("remittance_claims", "claim_number", element(1)),
        _wide("remittance_claims", "claim_status_code", element(2)),
        _wide("remittance_claims", "payer_claim_control_number", element(7)),
        _big("remittance_claims.billed_amount", element(3)),
        _big("remittance_claims.paid_amount", element(4)))
    adjustment = F.when(F.size(cas) > 0, F.coalesce(
        _wide("adjustments", "adjustment_group_code", element(1)),
        any_wide(cas, "adjustments", "adjustment_reason_code", "reason"),
        F.when(F.exists(cas, lambda a: overflows(a["amount"])),
               F.lit("numeric overflow in adjustments.adjustment_amount"))))
    remark = F.coalesce(F.nullif(element(2), F.lit("")), element(1))
    diagnosis = F.coalesce(any_wide(dx, "diagnoses", "diagnosis_code", "diagnosis_code"),
                           any_wide(dx, "diagnoses", "diagnosis_type", "diagnosis_type"))
    return (F.when(F.col("clm_ok"), claim).when(F.col("sv1_ok"), line)
            .when(name == "HI", diagnosis).when(F.col("clp_ok"), payment)
            .when((name == "CAS") & (element(1) != ""), adjustment)
            .when(name == "LQ", _wide("remark_codes", "remark_code", remark)))


def violations(annotated: DataFrame, catalogue: DataFrame, late: DataFrame) -> DataFrame:
    """Every broken rule: ``upload_seq, seg_pos, reason``."""
    name = F.col("segment_name")
    makes_row = (F.col("clm_ok") | F.col("sv1_ok") | F.col("clp_ok")
                 | ((name == "HI") & F.col("claim_id").isNotNull())
                 | (name.isin("CAS", "LQ") & F.col("remittance_claim_id").isNotNull()))
    by_row = annotated.where("raw_rule is not null or row_rule is not null").select(
        "upload_seq", "seg_pos",
        F.coalesce("raw_rule", F.when(makes_row, F.col("row_rule"))).alias("reason"))
    claims = claim_rows(annotated, late)
    carried = claims.select("upload_seq", "seg_pos", F.coalesce(*[
        _wide("claims", c, F.col(c)) for c in (
            "payer_name", "patient_member_id", "previous_payer_claim_control_no")]).alias("reason"))
    header = catalogue.select("upload_seq", F.lit(0).alias("seg_pos"), F.coalesce(*[
        _wide("edi_files", c, F.col(c)) for c in WIDTHS["edi_files"]]).alias("reason"))
    repeated = claims.groupBy("upload_seq", "claim_number").agg(
        F.count(F.lit(1)).alias("n"), F.max("seg_pos").alias("seg_pos")).where("n > 1").select(
        "upload_seq", "seg_pos",
        F.lit("duplicate key (edi_file_id, claim_number) in claims").alias("reason"))
    found = by_row.unionByName(carried).unionByName(header).unionByName(repeated)
    return found.where("reason is not null")


def rejected_files(found: DataFrame) -> DataFrame:
    """One row per rejected file with the first broken rule."""
    return found.groupBy("upload_seq").agg(F.min(F.struct("seg_pos", "reason")).alias("first")
                                           ).select("upload_seq", "first.reason")
