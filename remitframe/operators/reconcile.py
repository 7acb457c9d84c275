"""Matching payments to claims across files, placeholder claims and claim status.

Each upload sees what earlier uploads stored, so a payment goes to the first row ever made for
its claim number: the first good CLM, or a placeholder made by the first CLP. Ids sort in that
order, so "first" is one ``min`` per claim number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.contracts import CLAIM_STATUSES
from remitframe.functions.edi import as_of, claim_status_for, entity_id, position_of


def first_mentions(claims: DataFrame, remits: DataFrame,
                   stored: DataFrame | None = None) -> DataFrame:
    """Claim numbers not stored before, with their first row: ``claim_number, claim_id``.

    The group-by sends one partial row per task and number, so a hot number is harmless.
    """
    first = claims.select("claim_number", "claim_id").unionByName(
        remits.select("claim_number", F.col("remittance_claim_id").alias("claim_id"))
    ).groupBy("claim_number").agg(F.min("claim_id").alias("claim_id"))
    if stored is not None:
        first = first.join(stored.select("claim_number"), "claim_number", "left_anti")
    return first


def resolve(remits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Add ``claim_id`` to every remittance.

    ``mentions`` has one row per claim number, so this join never multiplies rows. A hot number
    sits on the left, where adaptive execution can split its partition.
    """
    return remits.join(mentions.select("claim_number", "claim_id"), "claim_number", "left")


def placeholders(resolved: DataFrame, as_of_date: str | None = None) -> DataFrame:
    """Claims made for payments that came first.

    A placeholder has the id of the payment that caused it, so no join is needed to find it.
    """
    return resolved.where(F.col("claim_id") == F.col("remittance_claim_id")).select(
        "claim_id", "claim_number", F.col("billed_amount").alias("total_charge_amount"),
        as_of(as_of_date).alias("service_from_date"), "upload_seq",
        F.lit(True).alias("is_placeholder"))


def _last_per_status(order: Column) -> list[Column]:
    """The last place of each status, as longs: the statuses are few, so a hash aggregate does."""
    return [F.max(F.when(F.col("claim_status") == s, order)).alias(f"_at_{s}")
            for s in CLAIM_STATUSES]


def _last_status() -> tuple[Column, Column]:
    """Status and place of the last of the places above."""
    at = F.greatest(*[F.col(f"_at_{s}") for s in CLAIM_STATUSES])
    return reduce(lambda out, s: F.when(F.col(f"_at_{s}") == at, s).otherwise(out),
                  CLAIM_STATUSES, F.lit(None).cast("string")), at


def status_updates(resolved: DataFrame) -> DataFrame:
    """Last mapped payment status per claim."""
    mapped = resolved.withColumn("claim_status", claim_status_for(F.col("claim_status_code")))
    status, at = _last_status()
    latest = mapped.where("claim_status is not null").groupBy("claim_id").agg(
        *_last_per_status(F.col("remittance_claim_id"))).select(
        "claim_id", status.alias("claim_status"), at.alias("at"))
    return latest.select("claim_id", "claim_status", F.shiftright("at", 31).alias("upload_seq"),
                         position_of(F.col("at")).alias("segment_position"))


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last update of each claim, with the time of the latest change."""
    status, at = _last_status()
    return updates.groupBy("claim_id").agg(
        *_last_per_status(entity_id(F.col("upload_seq"), F.col("segment_position"))),
        F.max("updated_at").alias("updated_at")).select(
        "claim_id", status.alias("claim_status"), F.shiftright(at, 31).alias("upload_seq"),
        position_of(at).alias("segment_position"), "updated_at")


def with_current_status(claims: DataFrame, updates: DataFrame) -> DataFrame:
    """Claims with the status of their latest payment, and when it changed."""
    latest = latest_updates(updates).select(
        "claim_id", F.col("claim_status").alias("_status"), F.col("updated_at").alias("_changed"))
    return claims.join(latest, "claim_id", "left").withColumns({
        "claim_status": F.coalesce("_status", F.lit("submitted")),
        "updated_at": F.greatest("created_at", "_changed"),
    }).drop("_status", "_changed")
