"""Rules of parsing, integrity and reconciliation, on small files."""

from __future__ import annotations

import os
import time
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remitframe.contracts import TABLES
from remitframe.operators.reconcile import first_mentions, latest_updates
from remitframe.operators.scan import local_scan
from remitframe.operators.segments import explode_segments, mark_segments
from remitframe.plans import reads
from remitframe.plans.dataset import build_dataset
from remitframe.plans.ingest import ingest
from remitframe.sources.codes import load_code_masters
from remitframe.sources import ranges
from remitframe.sources.files import Source, from_whole, read_edi
from remitframe.sources.keyed import KeyedTable, bucket_of
from remitframe.sources.store import Store
from remitframe.streaming.incremental import stream_ingest
from tests.edi_texts import (
    AS_OF, FILES, SAMPLE_835, SAMPLE_837, new_folder, text, write_files)

D = Decimal
TODAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    store = Store(spark, new_folder())
    ingest(read_edi(spark, write_files()), store, as_of_date=AS_OF)
    return store


@pytest.fixture(scope="module")
def seq(store):
    return {r.file_name: r.upload_seq for r in store.read("ingest_summary").collect()}


def rows(store, table, upload_seq, *columns, order=None):
    df = store.read(table).where(f"upload_seq = {upload_seq}")
    return [tuple(r) for r in df.orderBy(order or columns[0]).select(*columns).collect()]


def test_upload_numbers_follow_time(seq):
    assert sorted(seq, key=seq.get) == list(FILES)


def test_sample_837(store, seq):
    s = seq["sample837.edi"]
    assert rows(store, "claims", s, "claim_number", "total_charge_amount", "facility_type_code",
                "frequency_code", "payer_name", "patient_member_id", "service_from_date",
                "service_to_date") == [
        ("CLM-001", D(1500), "11", "1", "TEST PAYER", "PATIENT001", date(2023, 1, 15),
         date(2023, 1, 15)),
        ("CLM-002", D(800), "11", "1", "TEST PAYER", "PATIENT001", date(2023, 1, 20),
         date(2023, 1, 20))]
    assert rows(store, "claim_lines", s, "line_number", "procedure_code", "modifier1", "units",
                "billed_amount", "place_of_service", order="line_id") == [
        (1, "99213", None, D(1), D(150), None), (2, "99214", "25", D(1), D(350), None),
        (1, "99212", None, D(1), D(250), None), (2, "97140", None, D(2), D(550), None)]
    assert rows(store, "diagnoses", s, "claim_id", "sequence_number", "diagnosis_type",
                "diagnosis_code", order=["claim_id", "sequence_number"])[1][1:] == (
        2, "ABF", "R05.9")
    raw = rows(store, "raw_segments", s, "segment_position", "claim_id")
    ids = [None] * 7 + [(s << 31) + 8] * 8 + [(s << 31) + 16] * 10
    assert raw == list(enumerate(ids, start=1))


def test_sample_835(store, seq):
    s = seq["sample835.edi"]
    assert rows(store, "remittance_claims", s, "claim_number", "claim_status_code",
                "billed_amount", "paid_amount", "payer_claim_control_number",
                "remittance_date") == [
        ("CLM-001", "1", D(1500), D(1200), "MC", date(2023, 2, 1)),
        ("CLM-002", "4", D(800), D(0), "MC", date(2023, 2, 1))]
    assert rows(store, "adjustments", s, "segment_position", "adjustment_group_code",
                "adjustment_reason_code", "adjustment_amount") == [
        (9, "CO", "45", D(200)), (10, "PR", "2", D(100)), (13, "CO", "50", D(800))]
    assert rows(store, "remark_codes", s, "remark_id", "remark_code") == [
        ((s << 31) + 11, "N130"), ((s << 31) + 14, "N657")]
    assert {r.claim_id for r in store.read("raw_segments").where(
        f"upload_seq = {s}").collect()} == {None}
    summary = store.read("ingest_summary").where(f"upload_seq = {s}").first()
    assert (summary.claims_count, summary.remittance_claims_count, summary.success) == (0, 2, True)


def test_current_status(store):
    status = {r.claim_number: r.claim_status for r in reads.current_claims(store).collect()}
    assert status["CLM-001"] == "paid" and status["CLM-002"] == "denied"
    assert status["M1"] == "void" and status["C1"] == "submitted"


@pytest.mark.parametrize("name, error", [
    ("noisa.txt", "No ISA segment found in EDI file"),
    ("shortisa.edi", "ISA segment too short (100 chars, need 106)"),
    ("untyped.edi", "Cannot determine file type (no ST*837 or ST*835 found)"),
    ("dup.edi", "DB save failed: duplicate key (edi_file_id, claim_number) in claims"),
    ("longname.edi", "DB save failed: value too long for raw_segments.segment_name(10)"),
    ("longpos.edi", "DB save failed: value too long for claim_lines.place_of_service(2)"),
    ("bigcharge.edi", "DB save failed: numeric overflow in claims.total_charge_amount"),
    ("badf8.edi",
     "DB save failed: value too long for claims.previous_payer_claim_control_no(50)"),
])
def test_files_that_fail(store, seq, name, error):
    s = seq[name]
    assert rows(store, "ingest_errors", s, "error") == [(error,)]
    summary = store.read("ingest_summary").where(f"upload_seq = {s}").first()
    assert not summary.success and summary.raw_segments_count == 0
    for table in ("claims", "claim_lines", "raw_segments", "edi_files"):
        assert store.read(table).where(f"upload_seq = {s}").isEmpty()


def test_header_rules(store, seq):
    files = {r.upload_seq: r for r in store.read("edi_files").collect()}
    assert files[seq["twoisa.edi"]].sender_id == "OTHER"
    assert files[seq["twoisa.edi"]].interchange_control_no == "7"
    assert files[seq["secondst.edi"]].file_type == "edi_837"
    assert files[seq["sample835.edi"]].sender_id == "PAYER"


def test_other_delimiters_and_charset(store, seq):
    s = seq["otherseps.x12"]
    assert rows(store, "claim_lines", s, "procedure_code", "modifier1", "units",
                "place_of_service") == [("1", "A", D(2), "12")]
    assert rows(store, "diagnoses", s, "diagnosis_code") == [("X",)]
    assert rows(store, "claims", seq["latin.edi"], "payer_name", "facility_type_code",
                "frequency_code") == [("Caf\xe9", "", "1")]


def test_bad_claim_segments(store, seq):
    s = seq["badclm.edi"]
    claims = dict(rows(store, "claims", s, "claim_number", "claim_id"))
    assert set(claims) == {"B1", "B3"}
    assert rows(store, "claim_lines", s, "claim_id", "line_number", "procedure_code",
                order="line_id") == [
        (claims["B1"], 1, "1"), (claims["B1"], 2, "2"), (claims["B3"], 1, "3")]
    assert rows(store, "ingest_errors", s, "segment_position", "error") == [
        (6, "CLM at pos 6: CLM at pos 6: invalid total_charge_amount"),
        (8, "CLM at pos 8: CLM at pos 8: missing claim_number")]


def test_segments_before_a_claim(store, seq):
    s = seq["early.edi"]
    assert [e for _, e in rows(store, "ingest_errors", s, "segment_position", "error")] == [
        "SV1 at pos 4: SV1 at pos 4: no current claim in context",
        "HI at pos 5: HI at pos 5: no current claim in context"]
    assert rows(store, "claims", s, "service_from_date", "service_to_date") == [(TODAY, None)]


def test_units_and_bad_lines(store, seq):
    s = seq["units.edi"]
    assert rows(store, "claim_lines", s, "line_number", "units", "billed_amount") == [
        (1, D(1), D(1)), (2, D(1), D(1)), (3, D(1), D(1)), (4, D(1), D(1)),
        (5, D("2.5"), D("1.01"))]
    assert [e.split(": ", 2)[2] for _, e in rows(store, "ingest_errors", s, "segment_position",
                                                 "error")] == [
        "missing procedure_code (claim=U1)", "invalid billed_amount (claim=U1)"]


def test_service_date_ownership(store, seq):
    s = seq["dtp.edi"]
    # The failed line does not own the date; bad dates and ranges are ignored.
    assert rows(store, "claim_lines", s, "service_date") == [(date(2023, 1, 2),)]
    assert rows(store, "claims", s, "service_from_date", "service_to_date") == [
        (date(2023, 3, 5), date(2023, 3, 5))]


def test_carried_context(store, seq):
    assert rows(store, "claims", seq["carry.edi"], "claim_number", "payer_name",
                "patient_member_id", "previous_payer_claim_control_no") == [
        ("C1", "", "M1", "OLD2"), ("C2", "NEWPAYER", "M2", None), ("C3", "NEWPAYER", "M3", None)]
    assert rows(store, "claims", seq["longf8.edi"], "previous_payer_claim_control_no") == [
        ("ok",)]


def test_diagnosis_numbers(store, seq):
    s = seq["hi.edi"]
    assert rows(store, "diagnoses", s, "claim_id", "sequence_number", "diagnosis_type",
                "diagnosis_code", order=["claim_id", "sequence_number"]) == [
        ((s << 31) + 4, 1, "ABK", "A"), ((s << 31) + 4, 2, "ABF", "B"),
        ((s << 31) + 4, 3, "ABF", " C"), ((s << 31) + 8, 1, "ABK", "Z")]


def test_adjustments_and_remarks(store, seq):
    s = seq["cas.edi"]
    x1 = (s << 31) + 6
    assert rows(store, "adjustments", s, "remittance_claim_id", "segment_position",
                "adjustment_group_code", "adjustment_reason_code", "adjustment_amount",
                order="segment_position") == [
        (x1, 7, "CO", "50", D(5)), (x1, 14, "OA", "23", D(7))]
    assert rows(store, "remark_codes", s, "remark_code") == [("N9",)]
    assert rows(store, "remittance_claims", s, "claim_number", "paid_amount", "claim_status_code",
                "remittance_date") == [("X1", D(0), "5", TODAY)]
    assert [e.split(": ", 2)[2] for _, e in rows(store, "ingest_errors", s, "segment_position",
                                                 "error")] == [
        "no current remittance claim", "no current remittance claim",
        "missing adjustment_group_code", "missing remark_code", "missing claim_number",
        "invalid billed_amount (claim=X2)"]


def test_remittance_dates(store, seq):
    s = seq["dtm.edi"]
    assert rows(store, "remittance_claims", s, "claim_number", "remittance_date",
                order="remittance_claim_id") == [
        ("M1", date(2023, 1, 5)), ("M2", date(2023, 1, 7)), ("M1", date(2023, 1, 7)),
        ("M1", date(2023, 1, 7))]


def test_placeholders_and_late_claim(store, seq):
    s = seq["cas.edi"]
    x1 = (s << 31) + 6
    claims = {r.claim_id: r for r in reads.current_claims(store).where(
        "claim_number = 'X1'").collect()}
    assert claims[x1].is_placeholder and claims[x1].total_charge_amount == D(10)
    assert claims[x1].service_from_date == TODAY and claims[x1].claim_status == "submitted"
    late = (seq["late.edi"] << 31) + 4
    assert not claims[late].is_placeholder and len(claims) == 2
    # Three payments for M1 share one placeholder.
    summary = store.read("ingest_summary").where(f"upload_seq = {seq['dtm.edi']}").first()
    assert (summary.claims_count, summary.remittance_claims_count) == (2, 4)
    assert store.read("remittance_claims").where("claim_number = 'M1'").select(
        "claim_id").distinct().count() == 1


def table_rows(store, table):
    df = store.read(table).drop("created_at", "updated_at")
    return sorted(map(str, df.collect()))


SAME = [t for t in TABLES if t not in ("code_masters", "edi_text")]


@pytest.mark.parametrize("chunk_segments, partitions", [(3, 8), (200_000, 1)])
def test_layout_does_not_matter(spark, store, chunk_segments, partitions):
    """Files cut into chunks of three segments give the same tables: the scan carries exactly."""
    other = Store(spark, new_folder())
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ingest(read_edi(spark, write_files()), other, as_of_date=AS_OF,
               chunk_segments=chunk_segments)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for table in SAME:
        assert table_rows(other, table) == table_rows(store, table), table


def test_stream_equals_batch(spark):
    names = ["cas.edi", "sample837.edi", "sample835.edi", "late.edi"]
    batch, stream = Store(spark, new_folder()), Store(spark, new_folder())
    folder, checkpoint = write_files(names), new_folder()
    ingest(read_edi(spark, folder), batch, as_of_date=AS_OF)
    for _ in range(2):  # the second run finds nothing new
        query = stream_ingest(spark, folder, stream.path, checkpoint, as_of_date=AS_OF,
                              files_per_batch=2)
        query.awaitTermination()
        assert query.exception() is None
    assert len(stream.batches()) == 2 and stream.last_seq() == 4
    for table in SAME:
        assert table_rows(stream, table) == table_rows(batch, table), table


def test_ranges_equal_whole_files(spark):
    """Files cut into ranges of a few dozen bytes give the tables of whole files."""
    names = ["sample837.edi", "sample835.edi", "otherseps.x12", "badclm.edi", "noisa.txt",
             "shortisa.edi", "latin.edi", "twoisa.edi"]
    folder = write_files(names)
    whole, split = Store(spark, new_folder()), Store(spark, new_folder())
    ingest(read_edi(spark, folder), whole, as_of_date=AS_OF)
    source = read_edi(spark, folder, range_bytes=64, block_bytes=50)
    assert source.blocks.count() > 25
    ingest(source, split, as_of_date=AS_OF)
    for table in SAME:
        assert table_rows(split, table) == table_rows(whole, table), table


def _one(spark, name, text, tmp_path):
    folder = tmp_path / name
    folder.mkdir()
    (folder / f"{name}.edi").write_bytes(text.encode())
    return read_edi(spark, str(folder))


def test_batches_have_their_own_numbers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(_one(spark, "a", SAMPLE_837, tmp_path), store, as_of_date=AS_OF)
    ingest(_one(spark, "b", SAMPLE_835, tmp_path), store, as_of_date=AS_OF, keep_text=False)
    ingest(_one(spark, "c", text("837", "CLM*H2*10***11"), tmp_path), store, as_of_date=AS_OF)
    claims = reads.current_claims(store)
    found = {r.claim_number: r for r in claims.collect()}
    assert claims.count() == 3 and len({r.claim_id for r in found.values()}) == 3
    assert sorted(r.upload_seq for r in store.read("edi_files").collect()) == [1, 2, 3]
    # The 835 of the second batch changed the claims of the first, and only those.
    assert found["CLM-001"].claim_status == "paid" and found["CLM-002"].claim_status == "denied"
    assert found["CLM-001"].updated_at > found["CLM-001"].created_at
    assert found["H2"].updated_at == found["H2"].created_at
    # A table that a batch does not have is read from the others.
    assert {r.upload_seq for r in store.read("edi_text").collect()} == {1, 3}
    assert not (tmp_path / "store" / "staging").exists() or not any(
        p.is_file() for p in (tmp_path / "store" / "staging").rglob("*"))


def test_lookups_read_one_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name, number in (("a", "A1"), ("b", "B1")):
        ingest(_one(spark, name, text("837", f"CLM*{number}*10***11", "SV1*HC:1*1*UN*1"),
                    tmp_path), store, as_of_date=AS_OF)
    last = store.read("claims").where("claim_number = 'B1'").first()
    assert {f.split("batch=")[1][0] for f in store.read("claims", last.upload_seq).inputFiles()} \
        == {"1"}
    detail = reads.claim_detail(store, last.claim_id).first()
    assert detail.claim_number == "B1" and len(detail.claim_lines) == 1
    assert reads.find_claims(store, claim_number="A1").count() == 1


def files_read(df):
    """How many files the scan of a plan without exchanges opened."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_matching_state_stays_small(spark, tmp_path):
    """However many batches there were, one opens few folders of the partitions it touches."""
    store = Store(spark, str(tmp_path / "store"))
    expected, opened = {}, []
    for k in range(14):
        numbers = [f"N{k * 2}", f"N{k * 2 + 1}", "SAME"][:3 if k else 40]
        claims = spark.createDataFrame([(n, k * 10 + i) for i, n in enumerate(numbers)],
                                       "claim_number string, claim_id long")
        state = KeyedTable(store, "first_mentions", "claim_number", most_live=3)
        known = state.known(claims)
        if known is not None:
            assert {r.claim_number: r.claim_id for r in known.collect()} == {
                n: expected[n] for n in numbers if n in expected}
            touched = [r.b for r in claims.select(bucket_of(F.col("claim_number")).alias("b")).collect()]
            opened.append(files_read(state.stored(touched)))
        state.add(k, first_mentions(claims, claims.selectExpr(
            "claim_number", "claim_id AS remittance_claim_id").limit(0), known))
        store.commit(k, k + 1, k + 1, merged={state.table: state.merged},
                     held={state.table: state.rows})
        for i, n in enumerate(numbers):
            expected.setdefault(n, k * 10 + i)
    assert {r.claim_number: r.claim_id for r in store.read("first_mentions").collect()} == expected
    assert store.read("first_mentions").count() == len(expected)
    assert len(store.live("first_mentions")) <= 3 and max(opened) <= 9


def test_current_status_is_kept_not_recomputed(spark, tmp_path):
    """Claims read a bounded number of folders with about a row a claim, whatever the history."""
    store, expected = Store(spark, str(tmp_path / "store")), {}
    for k in range(9):
        updates = [(i, ("paid", "denied", "void")[(i + k) % 3], k + 1, i + 1)
                   for i in range(12) if (i + k) % 4 != 0]
        table = KeyedTable(store, "status_updates", "claim_id", latest_updates, most_live=3)
        table.add(k, spark.createDataFrame(
            updates, "claim_id long, claim_status string, upload_seq long, segment_position int"
            ).withColumn("updated_at", F.timestamp_seconds(F.lit(1_700_000_000 + k))))
        store.write("claims", k, spark.createDataFrame([(k,)], "claim_id long").withColumn(
            "created_at", F.timestamp_seconds(F.lit(1_600_000_000))))
        store.commit(k, k + 1, k + 1, merged={table.table: table.merged},
                     held={table.table: table.rows})
        expected |= {u[0]: (u[1], k) for u in updates}
    assert len(store.live("status_updates")) <= 3
    assert store.read("status_updates").count() <= 24
    found = {r.claim_id: (r.claim_status, int(r.updated_at.timestamp()) - 1_700_000_000)
             for r in reads.current_claims(store).collect()}
    assert found == {i: expected[i] for i in range(9)}


def rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_skip_what_lacks_the_value(spark, tmp_path):
    """Twenty batches whose numbers, members and payments lie all over: one batch's rows are read."""
    store = Store(spark, str(tmp_path / "store"))
    for k in range(20):
        frame = spark.range(0, 300, 1, 1).select(
            F.format_string("C%09d", F.col("id") * 20 + k).alias("claim_number"),
            F.format_string("M%09d", F.col("id") * 20 + k).alias("patient_member_id"),
            (F.col("id") * 20 + k).alias("claim_id"))
        for table in ("claims", "remittance_claims"):
            store.write(table, k, frame)
        store.commit(k, k + 1, k + 1)
    for table, column, value in (
            ("claims", "claim_number", "C000002007"), ("claims", "patient_member_id", "M000002007"),
            ("remittance_claims", "claim_number", "C000002007"),
            ("remittance_claims", "claim_id", 2007)):
        found = store.read(table).where(F.col(column) == value)
        assert found.count() == 1
        assert rows_scanned(found) <= 900, (table, column)   # false positives are rare
    size = sum(p.stat().st_size for p in (tmp_path / "store" / "claims").rglob("*.parquet"))
    assert size < 20 * 40_000


def test_a_page_reads_the_batches_it_lies_in(spark, tmp_path):
    """Claims of one batch have one time, or several that overlap with those of other batches."""
    store = Store(spark, str(tmp_path / "store"))
    for k in range(8):
        minute = F.lit(10 * k) if k < 5 else F.lit(10 * k) + F.col("id") - 12
        store.write("claims", k, spark.range(0, 20, 1, 1).select(
            (F.col("id") + 100 * k).alias("claim_id"), F.timestamp_seconds(
                1_700_000_000 + 60 * minute).alias("created_at")))
        store.commit(k, k + 1, k + 1)
    store.write("claims", 8, store.read("claims").limit(0))
    store.commit(8, 9, 9)

    def batches(page):
        return {int(f.split("/batch=")[1].split("/")[0]) for f in page.inputFiles()
                if "/claims/" in f}
    expected = [r.claim_id for r in store.read("claims").orderBy(
        F.desc("created_at"), F.desc("claim_id")).collect()]
    got, before = [], None
    while True:
        page = reads.list_claims(store, limit=15, before=before)
        assert len(batches(page)) <= 4
        rows_ = page.collect()
        if not rows_:
            break
        got += [r.claim_id for r in rows_]
        before = rows_[-1].created_at, rows_[-1].claim_id
    assert got == expected
    assert batches(reads.list_claims(store, 0, 5)) == {6, 7}
    late = reads.list_claims(store, 80, 20)
    assert [r.claim_id for r in late.collect()] == expected[80:100]
    assert 0 not in batches(late)
    assert batches(reads.list_claims(store, 0, 20, before=(rows_at(store, 3), 0))) == {2, 3}


def rows_at(store, batch):
    return store.read("claims", batches=[batch]).agg(F.max("created_at")).first()[0]


def test_commits_are_read_once_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(_one(spark, "a", SAMPLE_837, tmp_path), store, as_of_date=AS_OF)
    store.read("claims")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("reads", "reads")
    try:
        for table in TABLES:
            store.read(table)
        jobs = tracker.getJobIdsForGroup("reads")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    # Another handle's commit is seen.
    ingest(_one(spark, "b", SAMPLE_835, tmp_path), Store(spark, store.path), as_of_date=AS_OF)
    assert store.batches() == [0, 1] and store.read("remittance_claims").count() == 2


def test_two_streams_into_one_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name in ("first", "second"):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(2):
            (folder / f"{k}.edi").write_text(text("837", f"CLM*{name}{k}*10***11"))
        for _ in range(2):   # running a stream again reads nothing twice
            stream_ingest(spark, str(folder), store.path, str(tmp_path / f"{name}-checkpoint"),
                          as_of_date=AS_OF).awaitTermination()
    assert sorted(r.claim_number for r in store.read("claims").collect()) == [
        "first0", "first1", "second0", "second1"]


def test_a_stream_takes_files_that_come_late(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()
    for name, days in (("new", 0), ("late", 200)):
        file = folder / f"{name}.edi"
        file.write_text(text("837", f"CLM*{name}*10***11"))
        os.utime(file, (time.time() - days * 86400,) * 2)
        stream_ingest(spark, str(folder), store.path, str(tmp_path / "checkpoint"),
                      as_of_date=AS_OF).awaitTermination()
    assert {r.claim_number for r in store.read("claims").collect()} == {"new", "late"}


def test_codes_are_checked_and_outlive_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    codes = spark.createDataFrame([("pos", "11", "Office"), ("carc", "45", "Charge")],
                                  "code_type string, code string, description string")
    load_code_masters(store, codes)
    ingest(_one(spark, "a", SAMPLE_837, tmp_path), store, as_of_date=AS_OF)
    assert store.read("code_masters").count() == 2 and store.read("claims").count() == 2
    wrong = [[("pos", "11", "Again")], [("pos", "12", "a"), ("pos", "12", "b")],
             [("unknown", "1", "x")], [("pos", "12345678901", "x")], [("pos", None, "x")],
             [("pos", "13", None)], [("pos", "14", "x" * 501)]]
    for rows_ in wrong:
        with pytest.raises(ValueError, match="codes "):
            load_code_masters(store, spark.createDataFrame(rows_, codes.schema))
    assert store.read("code_masters").count() == 2


def test_any_terminator_and_charset_in_ranges_of_any_size(spark, tmp_path):
    """Each file its own terminator, control characters and non-ASCII ones too, in both charsets."""
    marks = "~\n'|\r\t\x00\x01\x1c\x1d\x1e\x7f!^#;$\x85\xa0\xa7\xe9\u20ac\u6f22\U0001d4b3"
    for k, mark in enumerate(marks):
        payer = text("837", "N1*PR*Caf\xe9 \xfc", "CLM*L1*10***:B:1", *[
            f"SV1*HC:{i}*1*UN*1" for i in range(12)], t=mark)
        for name, charset in (("latin", "latin-1"), ("utf", "utf-8")):
            if ord(mark) < 256 or charset == "utf-8":
                (tmp_path / f"{k:02d}{name}.edi").write_bytes(payer.encode(charset))
    (tmp_path / "a b%20+c.edi").write_bytes(text("837", "CLM*P1*10***:B:1").encode())

    def contents(source):
        files = {r.upload_seq: r for r in source.files.collect()}
        texts = {}
        for r in sorted(source.blocks.collect(), key=lambda r: (r.upload_seq, r.chunk)):
            texts[r.upload_seq] = texts.get(r.upload_seq, "") + r.text
        return {r.file_name: (r.terminator, r.element_sep, r.file_error, texts.get(k))
                for k, r in files.items()}
    whole = contents(from_whole(spark.read.format("binaryFile").load(str(tmp_path))))
    assert whole["a b%20+c.edi"][0] == "~"
    assert all(e is None for _, _, e, _ in whole.values()) and len(whole) == 46
    for size in (64, 7, 1 << 20):
        assert contents(read_edi(spark, str(tmp_path), range_bytes=size, block_bytes=97)) == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"~", "\xe9".encode(), "\u20ac".encode(),
                                 "\U0001d4b3".encode(), b"\xe9", b"\x80", b"\xf0", b"\xff"])),
       st.integers(1, 9), st.integers(1, 9))
def test_ranges_cover_every_byte_once(parts, size, block):
    content = b"".join(parts)
    read_at = lambda start, n: content[start:start + n]
    cuts = [(s, min(s + size, len(content))) for s in range(0, len(content), size)]
    found = [b for s, e in cuts for b in ranges.blocks_of(read_at, s, e, len(content), b"~", block)]
    assert b"".join(t for _, t in found) == content
    assert [p for p, _ in found] == sorted({p for p, _ in found})
    assert all(t.endswith(b"~") for _, t in found[:-1])
    try:
        content.decode()
        valid = True
    except UnicodeDecodeError:
        valid = False
    assert all(ranges.is_utf8(read_at, s, e, len(content)) for s, e in cuts) == valid


def test_no_exchange_above_the_text(spark, tmp_path):
    """Ingest's scan keeps segments where their blocks are read."""
    source = read_edi(spark, write_files(["sample837.edi", "sample835.edi"]))
    marked = mark_segments(explode_segments(source.blocks))
    plan = local_scan(marked)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("explode(")] if "explode(" in plan else plan
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above


def test_chunks_out_of_order_are_refused(spark):
    source = read_edi(spark, write_files(["sample837.edi"]), range_bytes=100, block_bytes=100)
    torn = Source(source.files, source.blocks.withColumn("block_seq", F.col("chunk")).withColumn(
        "chunk", F.lit(0).cast("long")).repartition(5, "block_seq"))
    with pytest.raises(ValueError, match="do not lie together"):
        ingest(torn, Store(spark, new_folder()), as_of_date=AS_OF)


def test_pages_by_key(spark, store):
    pages, before = [], None
    while True:
        page = reads.list_claims(store, limit=7, before=before).collect()
        if not page:
            break
        pages += [r.claim_id for r in page]
        before = (page[-1].created_at, page[-1].claim_id)
    assert pages == [r.claim_id for r in reads.list_claims(store, 0, 1000).collect()]


def test_status_aggregates_hash(spark, store):
    for df in (reads.current_claims(store), build_dataset(store)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
