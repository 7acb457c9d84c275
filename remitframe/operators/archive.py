"""Segment archive, parse errors and the file catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.contracts import PARSER_VERSION
from remitframe.functions.edi import elements_of, is_decimal, safe_element, split_composite
from remitframe.operators.claims import element, of_family


def _parse_error(elements: Column) -> Column:
    """Why a segment failed, or null. The message texts."""
    name = F.col("segment_name")

    def e(i):
        return safe_element(elements, i)
    procedure = F.coalesce(F.get(split_composite(e(1), F.col("component_sep")), F.lit(1)),
                           F.lit(""))
    no_claim, no_remit = F.col("claim_id").isNull(), F.col("remittance_claim_id").isNull()
    on_claim = F.concat(F.lit(" (claim="), F.col("open_claim_number"), F.lit(")"))
    problem_837 = (
        F.when((name == "CLM") & (e(1) == ""), F.lit("missing claim_number"))
        .when((name == "CLM") & ~is_decimal(e(2)), F.lit("invalid total_charge_amount"))
        .when(name.isin("SV1", "HI") & no_claim, F.lit("no current claim in context"))
        .when((name == "SV1") & (procedure == ""),
              F.concat(F.lit("missing procedure_code"), on_claim))
        .when((name == "SV1") & ~is_decimal(e(2)),
              F.concat(F.lit("invalid billed_amount"), on_claim)))
    problem_835 = (
        F.when((name == "CLP") & (e(1) == ""), F.lit("missing claim_number"))
        .when((name == "CLP") & ~is_decimal(e(3)),
              F.concat(F.lit("invalid billed_amount (claim="), e(1), F.lit(")")))
        .when(name.isin("CAS", "LQ") & no_remit, F.lit("no current remittance claim"))
        .when((name == "CAS") & (e(1) == ""), F.lit("missing adjustment_group_code"))
        .when((name == "LQ") & (e(1) == "") & (e(2) == ""), F.lit("missing remark_code")))
    # What opens a claim, a line or a remittance has no fault; the others are split here if at all.
    good = F.coalesce(F.col("clm_ok") | F.col("sv1_ok") | F.col("clp_ok"), F.lit(False))
    problem = F.when(good | ~name.isin("CLM", "SV1", "HI", "CLP", "CAS", "LQ"), None).when(
        F.col("file_type") == "edi_837", problem_837).otherwise(problem_835)
    return F.concat(name, F.lit(" at pos "), F.col("seg_pos").cast("string"), F.lit(": "), problem)


def raw_segments(annotated: DataFrame) -> DataFrame:
    """Every segment with its position, owner and error.

    ``claim_id`` is set for submissions only; a remittance row names its remittance instead.
    """
    return annotated.select(
        "upload_seq", F.col("seg_pos").alias("segment_position"), "segment_name", "claim_id",
        "remittance_claim_id", "raw_segment_text", _parse_error(
            elements_of(F.col("raw_segment_text"), F.col("element_sep"))).alias("parse_error"))


def parse_errors(archive: DataFrame) -> DataFrame:
    """One row per failed segment: the text a file's report carries."""
    return archive.where("parse_error is not null").select(
        "upload_seq", "segment_position",
        F.concat("segment_name", F.lit(" at pos "), F.col("segment_position").cast("string"),
                 F.lit(": "), "parse_error").alias("error"))


def edi_files(files: DataFrame, annotated: DataFrame) -> DataFrame:
    """Catalogue of readable files. With several ISA segments the last one counts."""
    headers = of_family(annotated, "ISA").groupBy("upload_seq").agg(
        F.max_by(F.struct(element(6).alias("sender_id"), element(8).alias("receiver_id"),
                          element(13).alias("interchange_control_no")),
                 F.col("seg_pos")).alias("isa"))
    types = annotated.where("family = 'OTHER'").where(F.col("segment_name") == "ST").groupBy(
        "upload_seq").agg(F.max("file_type").alias("file_type"))
    return (files.where("file_error is null").select("upload_seq", "file_name")
            .join(types, "upload_seq").join(headers, "upload_seq", "left")
            .select("upload_seq", "file_type", "file_name", "isa.interchange_control_no",
                    "isa.sender_id", "isa.receiver_id",
                    F.lit(PARSER_VERSION).alias("parser_version")))


def file_errors(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files that could not be read at all, with the reason."""
    unreadable = files.where("file_error is not null").select(
        "upload_seq", "file_name", F.col("file_error").alias("error"))
    untyped = files.where("file_error is null").join(
        catalogue.select("upload_seq"), "upload_seq", "left_anti").select(
        "upload_seq", "file_name",
        F.lit("Cannot determine file type (no ST*837 or ST*835 found)").alias("error"))
    return unreadable.unionByName(untyped)
