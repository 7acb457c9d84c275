"""What a build leaves on the disk, and for how long."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from remitframe.contracts import schema_of
from remitframe.operators.ordinal import sorted_partitions
from remitframe.plans import ingest as plan
from remitframe.session import FILE_BITS, kept_in_files
from remitframe.sources.files import Source, read_edi
from remitframe.sources.store import Store
from tests.edi_texts import AS_OF, new_folder, write_files

NAMES = ["sample837.edi", "sample835.edi", "cas.edi", "longpos.edi", "noisa.txt"]


def in_a_folder(spark, folder):
    source = read_edi(spark, write_files(NAMES))
    return Source(*[kept_in_files(df, f"{folder}/{name}") for name, df in (
        ("files", source.files), ("blocks", source.blocks))], str(folder))


def tables(store):
    return {t: sorted(map(str, store.read(t).drop("created_at", "updated_at").collect())) for t in (
        "claims", "claim_lines", "raw_segments", "remittance_claims", "ingest_errors", "ingest_summary")}


def test_text_is_deleted_once_it_is_read(spark, tmp_path, monkeypatch):
    kept, gone = Store(spark, new_folder()), Store(spark, new_folder())
    plan.ingest(in_a_folder(spark, tmp_path / "kept"), kept, as_of_date=AS_OF, keep_text=False)
    assert (tmp_path / "kept").exists()
    there = []
    claims_837 = plan.claims.claims_837
    monkeypatch.setattr(plan.claims, "claims_837", lambda *a: there.append(
        (tmp_path / "gone").exists()) or claims_837(*a))
    plan.ingest(in_a_folder(spark, tmp_path / "gone"), gone, as_of_date=AS_OF, keep_text=False,
                delete_source=True)
    assert there == [False]   # before any table is written
    assert tables(gone) == tables(kept)


def test_only_text_that_nobody_keeps_can_be_deleted(spark, tmp_path):
    source = in_a_folder(spark, tmp_path / "text")
    for wrong in ({"keep_text": True}, {"source": Source(source.files, source.blocks)}):
        with pytest.raises(ValueError, match="can be deleted"):
            plan.ingest(**{"source": source, "store": Store(spark, new_folder()), "keep_text": False,
                           "delete_source": True} | wrong)
    assert source.blocks.count()


def test_stored_and_staged_tables_are_compressed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(10).withColumn("family", F.lit("X"))
    store.stage("plain", 0, rows)
    store.stage("families", 0, rows, family="family")
    store.write("first_mentions", 0, rows.select(F.col("id").alias("claim_id")))
    files = [f for f in tmp_path.rglob("*.parquet") if pq.read_metadata(f).num_rows]
    assert {f.relative_to(tmp_path).parts[0] for f in files} == {"staging", "first_mentions"}
    assert {pq.read_metadata(f).row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_no_search_for_repeats_where_there_are_few(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    # Values that all are equal: each column would get a dictionary.
    rows = spark.range(1000, numPartitions=1).select(
        F.lit("CLM").alias("segment_name"), F.lit(1).alias("claim_id"),
        F.lit("CLM*1").alias("raw_segment_text"))
    store.stage("plain", 0, rows)
    store.write("raw_segments", 0, rows)
    found = {}
    for file in (f for f in tmp_path.rglob("*.parquet") if pq.read_metadata(f).num_rows):
        group = pq.read_metadata(file).row_group(0)
        for i in range(group.num_columns):
            column = group.column(i)
            found[file.relative_to(tmp_path).parts[0], column.path_in_schema] = column.encodings
    with_dictionary = {k for k, v in found.items() if any("DICTIONARY" in e for e in v)}
    assert ("raw_segments", "segment_name") in with_dictionary
    assert not with_dictionary & {("staging", c) for c in rows.columns}
    assert not with_dictionary & {("raw_segments", c) for c in ("claim_id", "raw_segment_text")}


def test_contracts_are_parsed_once(spark, monkeypatch):
    first = schema_of("claims")
    monkeypatch.setattr(StructType, "fromDDL", None)
    first.add("more", "long")
    assert "more" not in schema_of("claims").names


def test_files_are_read_whole_and_in_order(spark, tmp_path):
    """However small the pieces are that Spark reads files in."""
    n = 3 << FILE_BITS
    rows = spark.range(n, numPartitions=4).select("id", F.repeat(F.md5(F.col("id").cast(
        "string")), 4).alias("text"))
    kept = sorted_partitions(rows, [F.desc("id")], 2, ["id", "text"],
                             keep=lambda df: kept_in_files(df, str(tmp_path / "rows")))
    files = list(Path(tmp_path / "rows").rglob("*.parquet"))
    assert {pq.read_metadata(f).num_row_groups for f in files} == {1}
    assert max(pq.read_metadata(f).num_rows for f in files) == 1 << FILE_BITS
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = kept.select(
            "id", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"),
            (F.col("part") * 1000 + F.shiftright("row_in_part", FILE_BITS)).alias("file"))
        per_file = read.groupBy("file").agg(
            F.countDistinct("task").alias("tasks"), F.count("id").alias("n"),
            (F.max("at") - F.min("at") + 1).alias("places"),
            F.corr("at", "id").alias("falling")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r.n for r in per_file) == n and len(per_file) == len(files)
    assert all(r.tasks == 1 and r.places == r.n and r.falling < -0.999 for r in per_file)
