"""One batch of uploads: text -> committed tables."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.operators import archive, claims, integrity, reconcile, remits
from remitframe.operators.scan import apply_carry, chunk_carry, local_scan
from remitframe.operators.segments import CHUNK_SEGMENTS, explode_segments, mark_segments
from remitframe.session import (
    BROADCAST_ROWS, delete_folder, fits_broadcast, many_scan_tasks,
)
from remitframe.sources.files import Source
from remitframe.sources.keyed import KeyedTable
from remitframe.sources.store import Store

_COUNTED = {"claims": "claims_count", "claim_lines": "claim_lines_count",
            "diagnoses": "diagnoses_count", "remittance_claims": "remittance_claims_count",
            "adjustments": "adjustments_count", "remark_codes": "remark_codes_count",
            "raw_segments": "raw_segments_count"}
# Writes at a time.
WRITERS = 4


def annotate(source: Source, store: Store, batch: int,
             chunk_segments: int = CHUNK_SEGMENTS) -> DataFrame:
    """Segments with owner, numbering and carried context.

    The chunk-local half is staged once, in a folder per segment family, because every table
    reads it again and needs only its own families. Elements are split again there: that is cheaper than
    to store them beside the text. The row rules need no state, so they are found before the scan, from
    the elements that the marks were made of.
    """
    marked = integrity.with_row_rules(mark_segments(
        explode_segments(source.blocks, chunk_segments), keep_elements=True)).drop("elements")
    with many_scan_tasks(marked.sparkSession):
        scanned = store.stage("segments", batch, local_scan(marked).drop("elements"),
                              family="family")
    carry = store.stage("carry", batch, chunk_carry(scanned))
    return apply_carry(scanned, carry)


def ingest(source: Source, store: Store, batch: int | None = None,
           as_of_date: str | None = None, ingested_at: Column | None = None,
           chunk_segments: int = CHUNK_SEGMENTS, keep_text: bool = True,
           stream: str | None = None, stream_batch: int | None = None,
           delete_source: bool = False) -> int:
    """Parse, check, reconcile and commit one batch; returns its number.

    A source numbers its files from 1; here they get the numbers after the store's last one, so
    every upload has its own, whoever read it. Files rejected by the integrity rules leave no rows
    but a summary row. ``as_of_date`` stands for "today" wherever a date is missing. ``delete_source``
    deletes the source's folder as soon as its text has been read for the last time.
    """
    folder = source.folder
    if delete_source and (keep_text or not folder):
        raise ValueError("only a source in a folder, whose text is not kept, can be deleted")
    if batch is None:
        batch = max(store.batches(), default=-1) + 1
    # One time for the whole batch: a function of the clock would differ between the writes.
    stamp = F.timestamp_micros(F.lit(time.time_ns() // 1000)) if ingested_at is None \
        else ingested_at
    before = store.last_seq()
    source = Source(*[d.withColumn("upload_seq", F.col("upload_seq") + F.lit(before))
                      for d in (source.files, source.blocks)])
    files = store.stage("files", batch, source.files)
    segments = annotate(Source(files, source.blocks), store, batch, chunk_segments)
    if delete_source:
        delete_folder(store.spark, folder)
    # What does not wait for each other is submitted together, so that the cluster stays busy and a
    # small batch is not one short job after the other.
    with ThreadPoolExecutor(WRITERS) as pool:
        found = pool.submit(store.stage, "late", batch, claims.late_facts(segments))
        catalogue = store.stage("catalogue", batch, archive.edi_files(files, segments))
        late = found.result()
        if fits_broadcast(late):
            late = F.broadcast(late)
        rejected = store.stage("rejected", batch, integrity.rejected_files(
            integrity.violations(segments, catalogue, late)))
        good = segments
        if n_rejected := rejected.limit(BROADCAST_ROWS + 1).count():
            side = rejected.select("upload_seq")
            good = segments.join(F.broadcast(side) if n_rejected <= BROADCAST_ROWS else side,
                                 "upload_seq", "left_anti")
        # Claims and payments feed the matching, so they are stored before it.
        paid = pool.submit(store.stage, "payments", batch,
                           remits.remittances(good, late, as_of_date))
        tables = {
            "edi_files": catalogue.join(rejected, "upload_seq", "left_anti"),
            "remark_codes": remits.remark_codes(good),
            "adjustments": remits.adjustments(good),
            "diagnoses": claims.diagnoses(good),
            "claim_lines": claims.claim_lines(good, late),
            "raw_segments": archive.raw_segments(good),
        }
        tables = {t: df.withColumns({"created_at": stamp, "updated_at": stamp})
                  for t, df in tables.items()}
        if keep_text:
            tables["edi_text"] = source.blocks
        written = [pool.submit(store.write, t, batch, df) for t, df in tables.items()]
        own_claims = store.write("claims", batch, claims.claims_837(good, late, as_of_date)
                                 .withColumn("created_at", stamp))
        payments = paid.result()
        state = KeyedTable(store, "first_mentions", "claim_number")
        statuses = KeyedTable(store, "status_updates", "claim_id", reconcile.latest_updates)
        known = state.known(own_claims.select("claim_number").unionByName(
            payments.select("claim_number")))
        if known is not None:
            known = store.stage("known", batch, known)
        new = state.add(batch, reconcile.first_mentions(own_claims, payments, known))
        mentions = new if known is None else new.unionByName(known)
        resolved = store.write("remittance_claims", batch, reconcile.resolve(payments, mentions)
                               .withColumn("created_at", stamp))
        written.append(pool.submit(statuses.add, batch, reconcile.status_updates(
            resolved).withColumn("updated_at", stamp)))
        store.append("claims", batch, reconcile.placeholders(resolved, as_of_date)
                     .withColumn("created_at", stamp))
        for done in written:
            done.result()
    store.write("ingest_errors", batch, _errors(store, batch, files, catalogue, rejected))
    store.write("ingest_summary", batch, _summary(store, batch, files, catalogue, rejected))
    first_seq, last_seq = files.agg(F.min("upload_seq"), F.max("upload_seq")).first()
    if first_seq is not None and first_seq <= before:
        raise ValueError("a source has to number its files from 1")
    store.commit(batch, first_seq or before + 1, last_seq or before, stream, stream_batch,
                 {k.table: k.merged for k in (state, statuses)},
                 {k.table: k.rows for k in (state, statuses)})
    return batch


def _errors(store: Store, batch: int, files: DataFrame, catalogue: DataFrame,
            rejected: DataFrame) -> DataFrame:
    """All error texts of the batch, one row each. A rejected file reports only its rejection."""
    whole_file = archive.file_errors(files, catalogue).select("upload_seq", "error").unionByName(
        rejected.select("upload_seq", F.concat(F.lit("DB save failed: "), "reason")
                        .alias("error")))
    return archive.parse_errors(store.written("raw_segments", batch)).unionByName(
        whole_file.select("upload_seq", F.lit(None).cast("int").alias("segment_position"),
                          "error"))


def _summary(store: Store, batch: int, files: DataFrame, catalogue: DataFrame,
             rejected: DataFrame) -> DataFrame:
    """Per file: type, row counts, number of errors, success. Placeholders count as claims."""
    counted = {**_COUNTED, "ingest_errors": "errors_count"}
    counts = None
    for table, name in counted.items():
        one = store.written(table, batch).select(
            "upload_seq", *[F.lit(1 if n == name else 0).alias(n) for n in counted.values()])
        counts = one if counts is None else counts.unionByName(one)
    totals = counts.groupBy("upload_seq").agg(
        *[F.sum(n).alias(n) for n in counted.values()])
    saved = catalogue.join(rejected, "upload_seq", "left_anti").select(
        "upload_seq", F.lit(True).alias("success"))
    return (files.select("upload_seq", "file_name")
            .join(catalogue.select("upload_seq", "file_type"), "upload_seq", "left")
            .join(totals, "upload_seq", "left").join(saved, "upload_seq", "left")
            .select("upload_seq", "file_name", F.coalesce("file_type", F.lit("")).alias("file_type"),
                    *[F.coalesce(n, F.lit(0)).alias(n) for n in counted.values()],
                    F.coalesce("success", F.lit(False)).alias("success")))
