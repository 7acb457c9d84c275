"""Tables with one row per key that every batch looks up or changes.

``first_mentions`` holds which row first mentioned a claim number (payments are matched against it), and
``status_updates`` the current status of each claim that has one. Both are hash-partitioned by key. A batch
reads only the partitions that its own keys fall into, and adds a folder with its own rows. So that the
folders do not become ever more, a batch takes over those of the latest ones before it while they hold
no more rows than what it writes, and all once there are ``MOST_LIVE``: its commit names the batches
whose rows it holds too. A row is thus written again about as often as the table doubles, and a reader
opens at most ``MOST_LIVE`` folders, however long the history is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.contracts import schema_of
from remitframe.session import checked_join
from remitframe.sources.store import Store

# Part of the stored layout: must not change during a store's life.
BUCKETS = 64
MOST_LIVE = 8


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class KeyedTable:
    """A table as the store's commits have it, and what one batch adds to it.

    ``combine`` makes one row of several of a key; without it a key is only ever added once.
    """

    def __init__(self, store: Store, table: str, key: str,
                 combine: Callable[[DataFrame], DataFrame] | None = None,
                 most_live: int = MOST_LIVE):
        self.store, self.table, self.key = store, table, key
        self.combine, self.most_live = combine, most_live
        self.live = store.live(table)
        self.merged: list[int] = []
        self.rows = 0

    def stored(self, buckets: list[int] | None = None, batches: list[int] | None = None) -> DataFrame:
        """Rows of some partitions (all of them by default)."""
        names = schema_of(self.table).names
        chosen = [c.batch for c in self.live] if batches is None else batches
        if not chosen:
            return self.store.spark.createDataFrame([], schema_of(self.table))
        found = self.store.parts(self.table, [self.store.folder(self.table, b) for b in chosen],
                                 bucket="integer")
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return found.select(*names)

    def known(self, keys: DataFrame) -> DataFrame | None:
        """Stored rows of those keys; None for an empty table."""
        if not self.live:
            return None
        keys = keys.select(self.key).distinct()
        # One small row per partition, of which there are ``BUCKETS``.
        touched = [r.bucket for r in keys.select(
            bucket_of(F.col(self.key)).alias("bucket")).distinct().collect()]
        return checked_join(self.stored(touched), keys, self.key, "left_semi")

    def add(self, batch: int, new: DataFrame) -> DataFrame:
        """Writes the rows that a batch adds, and gives them back."""
        if not self.live:   # nothing to take over
            self.store.write_parts(self.table, batch, new, bucket_of(F.col(self.key)))
            new = self.store.written(self.table, batch)
            self.rows = new.count()
            return new
        new = self.store.stage(self.table, batch, new)
        self.rows = new.count()
        kept = list(self.live)
        while kept and (self.rows >= kept[-1].held[self.table] or len(kept) >= self.most_live):
            self.rows += kept[-1].held[self.table]
            self.merged.append(kept.pop().batch)
        whole = new
        if self.merged:
            whole = new.unionByName(self.stored(batches=self.merged), allowMissingColumns=True)
            whole = self.combine(whole) if self.combine else whole
        self.store.write_parts(self.table, batch, whole, bucket_of(F.col(self.key)))
        if self.merged and self.combine:
            self.rows = self.store.written(self.table, batch).count()
        return new
