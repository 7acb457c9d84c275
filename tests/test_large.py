"""What has to stay small however many files there are."""

from __future__ import annotations

from remitframe.session import few_listing_tasks, small_methods
from remitframe.sources.files import RANGE_BYTES, listing_of, range_tasks
from remitframe.sources.store import Store
from remitframe.streaming.incremental import stream_ingest


def test_small_ranges_do_not_mean_many_tasks():
    small = 1 << 16
    assert range_tasks(4 << 30, (4 << 30) // small, 12, small) <= 4 * 12 + (4 << 30) // RANGE_BYTES
    assert range_tasks(4 << 30, 64, 12, RANGE_BYTES) == 64
    assert range_tasks(10 * small, 10, 8, small) == 8
    assert range_tasks(0, 0, 8, small) == 1


def test_a_large_backlog_is_read_in_few_micro_batches(spark, tmp_path):
    for n in range(7):
        (tmp_path / "in" / str(n)).mkdir(parents=True)
        (tmp_path / "in" / str(n) / "a.edi").write_text("none")
    folder = f"file:{tmp_path}/in"
    assert listing_of(spark, folder).count() == 7
    stream_ingest(spark, folder, f"{tmp_path}/store", f"{tmp_path}/point", as_of_date="2020-01-01",
                  files_per_batch=1, most_batches=2).awaitTermination()
    store = Store(spark, f"{tmp_path}/store")
    assert [r.last_seq - r.first_seq + 1 for r in store._commits()] == [4, 3]
    assert store.read("ingest_summary").count() == 7


def test_settings_go_back(spark):
    names = ("spark.sql.codegen.hugeMethodLimit",
             "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(n) for n in names]
    with small_methods(spark), few_listing_tasks(spark):
        assert [spark.conf.get(n) for n in names] != before
    assert [spark.conf.get(n) for n in names] == before
