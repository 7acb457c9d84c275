"""Blocks of text -> segments, and what each segment means on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.functions.edi import (
    diagnosis_entries, elements_of, is_blank, is_decimal, safe_date, safe_element, segment_name,
    split_composite, split_on, strip,
)

CHUNK_SEGMENTS = 200_000

# Segments with a handler are stored apart, so that each table reads only its own.
FAMILIES = ("CLM", "SV1", "HI", "DTP", "REF", "CLP", "DTM", "CAS", "LQ", "ISA")


def explode_segments(blocks: DataFrame, chunk_segments: int = CHUNK_SEGMENTS) -> DataFrame:
    """One row per non-blank segment, in order of ``(chunk, block_seq, idx)`` within a file.

    A long one-block file is cut into chunks of ``chunk_segments``.
    """
    pieces = blocks.select(
        "upload_seq", "chunk", "block_seq", "element_sep", "component_sep",
        F.posexplode(split_on(F.col("text"), F.col("terminator"))).alias("idx", "piece")).where(
            ~is_blank(F.col("piece")))
    return pieces.select(
        "upload_seq",
        (F.col("chunk") + F.floor(F.col("idx") / chunk_segments)).alias("chunk"),
        "block_seq", "idx", "element_sep", "component_sep",
        # Line ends in front are so common that they go first, the cheap way.
        strip(F.ltrim("piece", F.lit("\r\n"))).alias("raw_segment_text"))


def with_family(segments: DataFrame) -> DataFrame:
    name = F.col("segment_name")
    return segments.withColumn("family", F.when(name.isin(*FAMILIES), name).otherwise("OTHER"))


def with_elements(segments: DataFrame) -> DataFrame:
    """Add ``elements`` to the segments that have a handler."""
    return segments.withColumn("elements", F.when(F.col("family") != "OTHER", elements_of(
        F.col("raw_segment_text"), F.col("element_sep"))))


def mark_segments(segments: DataFrame, keep_elements: bool = False) -> DataFrame:
    """Add the facts that depend on the segment alone, and on request ``elements``.

    ``clm_ok``, ``clp_ok`` - opens a claim / remittance; ``sv1_ok`` - a line, if a claim is open;
    ``dx_count`` - diagnoses, if a claim is open; ``payer_set``, ``member_set``, ``remit_day`` -
    values carried to later segments; ``st_type`` - the file type an ST segment names; ``service_day``,
    ``control_no`` - what belongs to an earlier claim or line.
    """
    e = F.col("elements")
    name = F.col("segment_name")
    first, second = safe_element(e, 1), safe_element(e, 2)
    member = F.nullif(safe_element(e, 9), F.lit(""))
    procedure = F.coalesce(F.get(split_composite(first, F.col("component_sep")), F.lit(1)),
                           F.lit(""))
    split = segments.withColumn("elements", elements_of(F.col("raw_segment_text"),
                                                        F.col("element_sep")))
    marked = split.withColumn("segment_name", segment_name(e)).withColumns({
        "clm_ok": (name == "CLM") & (first != "") & is_decimal(second),
        "sv1_ok": (name == "SV1") & (procedure != "") & is_decimal(second),
        "dx_count": F.when(name == "HI", F.size(diagnosis_entries(e, F.col("component_sep")))
                           ).otherwise(0),
        "clp_ok": (name == "CLP") & (first != "") & is_decimal(safe_element(e, 3)),
        "payer_set": F.when((name == "N1") & (first == "PR"), second).when(
            (name == "NM1") & (first == "PR"), F.nullif(safe_element(e, 3), F.lit(""))),
        "member_set": F.when((name == "NM1") & first.isin("IL", "QC"), member).when(
            (name == "REF") & (first == "1W"), F.nullif(second, F.lit(""))),
        "remit_day": F.when((name == "DTM") & (first == "050"), safe_date(second)),
        "service_day": F.when((name == "DTP") & (first == "472"), safe_date(safe_element(e, 3))),
        "control_no": F.when((name == "REF") & (first == "F8"), F.nullif(second, F.lit(""))),
        "st_type": F.when((name == "ST") & first.isin("837", "835"),
                          F.concat(F.lit("edi_"), first)),
        "own_number": F.when(name.isin("CLM", "CLP"), first),
    })
    return marked if keep_elements else marked.drop("elements")
