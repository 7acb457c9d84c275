"""Table contracts: column types, string widths and closed value sets.

Fixed values: widths and enum members are those of the relational model being reproduced.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_TYPES = ("edi_837", "edi_835")
CLAIM_STATUSES = ("submitted", "paid", "denied", "partially_paid", "void")
CODE_TYPES = ("carc", "rarc", "pos", "claim_status")
PARSER_VERSION = "1.0.0"

_DDL = {
    "edi_files": """
        upload_seq long, file_type string, file_name string, interchange_control_no string,
        sender_id string, receiver_id string, parser_version string,
        created_at timestamp, updated_at timestamp""",
    "edi_text": """
        upload_seq long, chunk long, block_seq long, text string""",
    "claims": """
        claim_id long, claim_number string, payer_name string, patient_member_id string,
        total_charge_amount decimal(12,2), facility_type_code string, frequency_code string,
        service_from_date date, service_to_date date, upload_seq long,
        previous_payer_claim_control_no string, is_placeholder boolean,
        raw_claim_segment string, created_at timestamp""",
    "claim_lines": """
        line_id long, claim_id long, line_number int, procedure_code string, modifier1 string,
        modifier2 string, units decimal(10,2), billed_amount decimal(12,2), service_date date,
        place_of_service string, upload_seq long, raw_sv1_segment string, created_at timestamp""",
    "diagnoses": """
        claim_id long, sequence_number int, diagnosis_code string, diagnosis_type string,
        upload_seq long, raw_hi_segment string, created_at timestamp""",
    "remittance_claims": """
        remittance_claim_id long, claim_id long, claim_number string, claim_status_code string,
        billed_amount decimal(12,2), paid_amount decimal(12,2),
        payer_claim_control_number string, remittance_date date, upload_seq long,
        raw_clp_segment string, created_at timestamp""",
    "adjustments": """
        remittance_claim_id long, segment_position int, ordinal int,
        adjustment_group_code string, adjustment_reason_code string,
        adjustment_amount decimal(12,2), upload_seq long, raw_cas_segment string,
        created_at timestamp""",
    "remark_codes": """
        remark_id long, remittance_claim_id long, remark_code string, upload_seq long,
        raw_lq_segment string, created_at timestamp""",
    "raw_segments": """
        upload_seq long, segment_position int, segment_name string, claim_id long,
        remittance_claim_id long, raw_segment_text string, parse_error string,
        created_at timestamp""",
    "code_masters": "code_type string, code string, description string",
    # Bookkeeping of the store.
    "first_mentions": "claim_number string, claim_id long",
    "status_updates": """
        claim_id long, claim_status string, upload_seq long, segment_position int,
        updated_at timestamp""",
    "ingest_errors": "upload_seq long, segment_position int, error string",
    "ingest_summary": """
        upload_seq long, file_name string, file_type string, claims_count long,
        claim_lines_count long, diagnoses_count long, remittance_claims_count long,
        adjustments_count long, remark_codes_count long, raw_segments_count long,
        errors_count long, success boolean""",
}

TABLES = tuple(_DDL)

# Columns that single values are looked up in, though their values lie anywhere in a table. Files
# get Bloom filters on them; the ids of children rise with the files' order, so their ranges do.
LOOKED_UP = {
    "claims": ("claim_number", "patient_member_id"),
    "remittance_claims": ("claim_id", "claim_number"),
    "status_updates": ("claim_id",),
}


@cache
def _parsed(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])   # asks the JVM, which every batch would do dozens of times


def schema_of(table: str) -> StructType:
    return StructType(list(_parsed(table).fields))


# Width in characters of every bounded string column.
WIDTHS = {
    "edi_files": {"file_name": 255, "interchange_control_no": 20, "sender_id": 50,
                  "receiver_id": 50},
    "claims": {"claim_number": 50, "payer_name": 255, "patient_member_id": 80,
               "facility_type_code": 10, "frequency_code": 5,
               "previous_payer_claim_control_no": 50},
    "claim_lines": {"procedure_code": 10, "modifier1": 5, "modifier2": 5,
                    "place_of_service": 2},
    "diagnoses": {"diagnosis_code": 10, "diagnosis_type": 10},
    "remittance_claims": {"claim_number": 50, "claim_status_code": 10,
                          "payer_claim_control_number": 50},
    "adjustments": {"adjustment_group_code": 5, "adjustment_reason_code": 10},
    "remark_codes": {"remark_code": 10},
    "raw_segments": {"segment_name": 10},
    "code_masters": {"code": 10, "description": 500},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` on the columns and types of ``table``; absent columns become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType.simpleString())
        .alias(f.name) for f in schema_of(table).fields
    ])
