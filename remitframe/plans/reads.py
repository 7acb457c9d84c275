"""Read queries over a committed store: pages, detail, denials and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.operators.reconcile import with_current_status
from remitframe.session import (
    BROADCAST_ROWS, HOT_ROWS, checked_join, checkpointed, split_join)
from remitframe.sources.store import Store

_RAW = ("raw_claim_segment", "raw_sv1_segment", "raw_hi_segment", "raw_clp_segment",
        "raw_cas_segment", "raw_lq_segment")


def current_claims(store: Store) -> DataFrame:
    """All claims with their current status."""
    return with_current_status(store.read("claims"), store.read("status_updates"))


def _page_batches(store: Store, needed: int, before: datetime | None) -> list[int] | None:
    """The batches that a page lies in, found in the commit rows alone.

    Newest first, batches are taken until they hold ``needed`` claims, and then those that have a claim
    as new as any of these. None if a commit does not say when its claims were made.
    """
    commits = [r for r in store.live("claims") if r.claims != 0]
    if any(r.newest is None for r in commits):
        return None
    taken, n, oldest = [], 0, None
    for r in sorted(commits, key=lambda r: r.newest, reverse=True):
        if n >= needed and r.newest < oldest:
            break
        if before is not None and r.oldest > before:
            continue
        taken.append(r.batch)
        # A batch that may lie on both sides of the page's start is taken but not counted.
        if n < needed and (before is None or r.newest < before):
            n += r.claims
            oldest = r.oldest if oldest is None else min(oldest, r.oldest)
    return taken


def list_claims(store: Store, skip: int = 0, limit: int = 100,
                before: tuple[datetime, int] | None = None) -> DataFrame:
    """A page of claims, newest first; ties on the upload time go by id.

    ``before`` is (created_at, claim_id) of the last claim of the page before this one. It is pushed
    into the scan, and each task keeps ``limit`` rows however deep the page is, while ``skip`` has
    it keep all rows skipped as well. Only the batches that the page lies in are read. The page is cut
    before the status is looked up, so the join side is at most ``limit`` rows.
    """
    claims = store.read("claims", batches=_page_batches(
        store, skip + limit, before and before[0])).drop(*_RAW)
    if before is not None:
        time, last = (F.lit(v) for v in before)
        claims = claims.where((F.col("created_at") <= time) & (
            (F.col("created_at") < time) | (F.col("claim_id") < last)))
    page = claims.orderBy(F.desc("created_at"), F.desc("claim_id")).offset(skip).limit(limit)
    ids = page.select("claim_id")
    updates = store.read("status_updates").join(
        F.broadcast(ids) if limit <= BROADCAST_ROWS else ids, "claim_id", "left_semi")
    return with_current_status(page, updates).orderBy(F.desc("created_at"), F.desc("claim_id"))


def list_edi_files(store: Store, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of the file catalogue, newest first."""
    return store.read("edi_files").orderBy(
        F.desc("created_at"), F.desc("upload_seq")).offset(skip).limit(limit)


def claim_detail(store: Store, claim_id: int) -> DataFrame:
    """One claim with its children nested two deep; no row when the id is unknown.

    The id filter reaches every scan. A claim and its lines and diagnoses come from one upload,
    so only its batch is read for them; payments may be in any. This is a point lookup: the
    arrays hold one claim's children. For many claims at once use ``claim_tree``.
    """
    own = claim_id >> 31

    def children(table: str, key: str, order: list[str], name: str, ids=None) -> DataFrame:
        rows = store.read(table, own if ids is None else None).drop(*_RAW)
        rows = rows.where(F.col(key) == claim_id) if ids is None else rows.join(
            ids, key, "left_semi")
        rest = [c for c in rows.columns if c not in (*order, key)]
        return rows.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    claim = with_current_status(
        store.read("claims", own).drop(*_RAW).where(F.col("claim_id") == claim_id),
        store.read("status_updates").where(F.col("claim_id") == claim_id))
    remits = store.read("remittance_claims").drop(*_RAW).where(F.col("claim_id") == claim_id)
    ids = remits.select("remittance_claim_id")
    remits = remits.join(children("adjustments", "remittance_claim_id",
                                  ["segment_position", "ordinal"], "adjustments", ids),
                         "remittance_claim_id", "left")
    remits = remits.join(children("remark_codes", "remittance_claim_id", ["remark_id"],
                                  "remark_codes", ids), "remittance_claim_id", "left")
    for name in ("adjustments", "remark_codes"):
        remits = remits.withColumn(name, F.coalesce(name, F.array()))
    payments = remits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(
        "remittance_claim_id", *[c for c in remits.columns
                                 if c not in ("remittance_claim_id", "claim_id")]))
    ).alias("remittance_claims"))
    out = claim.join(children("claim_lines", "claim_id", ["line_number"], "claim_lines"),
                     "claim_id", "left")
    out = out.join(children("diagnoses", "claim_id", ["sequence_number"], "diagnoses"),
                   "claim_id", "left").join(payments, "claim_id", "left")
    return out.withColumns({n: F.coalesce(n, F.array())
                            for n in ("claim_lines", "diagnoses", "remittance_claims")})


def claim_tree(store: Store) -> DataFrame:
    """All claims with all descendants in long form, one row per node.

    ``(claim_id, section, parent_id, ordinal)`` places a node; ``code``, ``detail``, ``amount``
    and ``day`` are its main values. Nothing is gathered per claim, so a claim with any number
    of children is fine.
    """
    def node(df, section, parent, ordinal, code, detail=None, amount=None, day=None):
        def col(c, kind):
            return (F.lit(None) if c is None else F.col(c)).cast(kind)
        return df.select(
            "claim_id", F.lit(section).alias("section"), col(parent, "long").alias("parent_id"),
            col(ordinal, "long").alias("ordinal"), col(code, "string").alias("code"),
            col(detail, "string").alias("detail"), col(amount, "decimal(12,2)").alias("amount"),
            col(day, "date").alias("day"))
    remits = store.read("remittance_claims")
    owner = remits.select("remittance_claim_id", "claim_id")
    adjustments = store.read("adjustments").join(owner, "remittance_claim_id").withColumn(
        "place", F.when(F.col("ordinal") < 1 << 20, F.shiftleft(
            F.col("segment_position").cast("long"), 20) + F.col("ordinal")).otherwise(
            F.raise_error(F.lit("a segment has over a million adjustments")).cast("long")))
    remarks = store.read("remark_codes").join(owner, "remittance_claim_id")
    parts = [
        node(current_claims(store), "claim", None, None, "claim_number", "claim_status",
             "total_charge_amount", "service_from_date"),
        node(store.read("claim_lines"), "line", "claim_id", "line_number", "procedure_code",
             "modifier1", "billed_amount", "service_date"),
        node(store.read("diagnoses"), "diagnosis", "claim_id", "sequence_number",
             "diagnosis_code", "diagnosis_type"),
        node(remits, "remittance", "claim_id", "remittance_claim_id", "claim_status_code",
             "payer_claim_control_number", "paid_amount", "remittance_date"),
        node(adjustments, "adjustment", "remittance_claim_id", "place",
             "adjustment_reason_code", "adjustment_group_code", "adjustment_amount"),
        node(remarks, "remark", "remittance_claim_id", "remark_id", "remark_code"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def denials(store: Store, claim_id: int | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Denied claims with their payments, adjustments and remarks, one row per detail.

    Details are stacked, not paired with each other. ``code`` and ``amount`` are the status code
    and paid amount of a payment, the reason and amount of an adjustment, or a remark code.
    """
    claims, updates = store.read("claims"), store.read("status_updates")
    remits = store.read("remittance_claims")
    if claim_id is not None:
        claims, updates, remits = [d.where(F.col("claim_id") == claim_id)
                                   for d in (claims, updates, remits)]
    denied = with_current_status(claims, updates).where("claim_status = 'denied'").select(
        "claim_id", "claim_number", "payer_name", "total_charge_amount")
    # Only payments of denied claims are counted for hot ones.
    denied = checkpointed(denied)
    few = checked_join(remits.select("claim_id", "remittance_claim_id"),
                       denied.select("claim_id"), "claim_id", "left_semi")
    payments = split_join(few, denied, "claim_id", "remittance_claim_id", hot_rows)
    adjustments, remarks = store.read("adjustments"), store.read("remark_codes")
    if claim_id is not None:   # only the details of the claim's payments
        ids = payments.select("remittance_claim_id")
        adjustments, remarks = [d.join(ids, "remittance_claim_id", "left_semi")
                                for d in (adjustments, remarks)]
    details = remits.select(
        "remittance_claim_id", F.lit("payment").alias("detail_type"),
        F.lit(None).cast("string").alias("group_code"),
        F.col("claim_status_code").alias("code"), F.col("paid_amount").alias("amount")
    ).unionByName(adjustments.select(
        "remittance_claim_id", F.lit("adjustment").alias("detail_type"),
        F.col("adjustment_group_code").alias("group_code"),
        F.col("adjustment_reason_code").alias("code"),
        F.col("adjustment_amount").alias("amount"))
    ).unionByName(remarks.select(
        "remittance_claim_id", F.lit("remark").alias("detail_type"),
        F.col("remark_code").alias("code")), allowMissingColumns=True)
    # Payments have one row per id, so only a payment with very many details is hot, on the
    # left, where adaptive execution can divide it.
    return details.join(payments, "remittance_claim_id")


def with_code_descriptions(df: DataFrame, codes: DataFrame, code_type: str, code: str,
                           name: str = "description") -> DataFrame:
    """Add the description of ``code``; null where the code table has none."""
    wanted = codes.where(F.col("code_type") == code_type).select(
        F.col("code").alias(code), F.col("description").alias(name))
    return checked_join(df, wanted, code, "left")


def find_claims(store: Store, claim_number: str | None = None,
                patient_member_id: str | None = None, claim_status: str | None = None,
                upload_seq: int | None = None) -> DataFrame:
    """Claims by the keyed columns. All but the status are pushed into the scan."""
    wanted: list[Column] = [F.col(name) == value for name, value in (
        ("claim_number", claim_number), ("patient_member_id", patient_member_id),
        ("upload_seq", upload_seq)) if value is not None]
    claims, updates = store.read("claims", upload_seq), store.read("status_updates")
    for condition in wanted:
        claims = claims.where(condition)
    if wanted:   # few claims: only their updates are aggregated
        updates = updates.join(claims.select("claim_id"), "claim_id", "left_semi")
    found = with_current_status(claims, updates)
    return found if claim_status is None else found.where(F.col("claim_status") == claim_status)


def find_adjustments(store: Store, reason_code: str) -> DataFrame:
    """Adjustments with one reason code; the filter is pushed into the scan."""
    return store.read("adjustments").where(F.col("adjustment_reason_code") == reason_code)
