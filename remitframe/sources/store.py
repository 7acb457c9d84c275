"""Append-only Parquet store with committed batches.

``<path>/<table>/batch=N`` holds what batch N added. A batch counts only once its row is in
``<path>/commits``, which is written last: readers see all of a batch or nothing, and a batch
that is run again after a failure replaces its own folders. The row names the tables the batch
has, the range of its upload numbers, the stream and micro-batch it came from, if any, and earlier batches
whose rows of a keyed table it holds too (``keyed.py``). Staged frames of a batch are deleted once it is
committed. Commit rows are read once per version of the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from remitframe.contracts import LOOKED_UP, conform, schema_of
from remitframe.session import COMPRESSION, PLAIN, setting

_COMMITS = ("batch long, first_seq long, last_seq long, tables array<string>, stream string, "
            "stream_batch long, committed_at timestamp, "
            "merged map<string, array<long>>, held map<string, long>, claims long, oldest timestamp, newest timestamp")
# Ids hold an upload number above a 31-bit position.
MAX_SEQ = (1 << 32) - 1


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v)])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._written: dict[int, set[str]] = {}
        self._version, self._rows = None, []

    def _hadoop(self, path: str):
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(context._jsc.hadoopConfiguration())

    def folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def _commits(self) -> list[Row]:
        """Commit rows in order, one small row a batch. Read again only if their folder has changed."""
        folder, files = self._hadoop(f"{self.path}/commits")
        if not files.exists(folder):
            return []
        size = files.getContentSummary(folder)
        version = size.getDirectoryCount(), size.getFileCount(), size.getLength()
        if version != self._version:
            self._rows = sorted(self.spark.read.schema(_COMMITS).parquet(
                f"{self.path}/commits").collect(), key=lambda r: r.batch)
            self._version = version
        return self._rows

    def batches(self) -> list[int]:
        return [r.batch for r in self._commits()]

    def live(self, table: str) -> list[Row]:
        """Commits of the batches that a table is read from."""
        commits = self._commits()
        gone = {b for r in commits for b in (r.merged or {}).get(table, ())}
        return [r for r in commits if table in r.tables and r.batch not in gone]

    def last_seq(self) -> int:
        """Highest upload number handed out so far."""
        return max((r.last_seq for r in self._commits()), default=0)

    def write(self, table: str, batch: int, df: DataFrame) -> DataFrame:
        """Write the rows a batch adds to a table and read them back."""
        self._written.setdefault(batch, set()).add(table)
        self._writer(table, conform(df, table)).mode("overwrite").parquet(self.folder(table, batch))
        return self.written(table, batch)

    @staticmethod
    def _writer(table: str, df: DataFrame):
        """A lookup by one of the ``LOOKED_UP`` columns skips the row groups that lack its value. The
        filters are sized by what they hold."""
        writer = df.write.options(**COMPRESSION).option(
            "parquet.bloom.filter.adaptive.enabled", "true")
        # Text of segments and ids are so rarely equal that a search for repeats only takes time.
        for column in schema_of(table).names:
            if column.startswith("raw_") or column.endswith(("_id", "_position")):
                writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
        for column in LOOKED_UP.get(table, ()):
            # Candidates from 1 MB down to 2 KB; the smallest that is good enough is stored.
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                f"parquet.bloom.filter.candidates.number#{column}", "10")
        return writer

    def write_parts(self, table: str, batch: int, df: DataFrame, bucket: Column) -> None:
        """Write what a batch adds in a folder per ``bucket``, each by one task and sorted."""
        self._written.setdefault(batch, set()).add(table)
        rows = conform(df, table).withColumn("bucket", bucket).repartition("bucket")
        self._writer(table, rows.sortWithinPartitions("bucket", *schema_of(table).names)).mode(
            "overwrite").partitionBy("bucket").parquet(self.folder(table, batch))

    def append(self, table: str, batch: int, df: DataFrame) -> None:
        """Add rows to what ``write`` wrote in the same run of the batch."""
        self._writer(table, conform(df, table)).mode("append").parquet(self.folder(table, batch))

    def written(self, table: str, batch: int) -> DataFrame:
        """Rows of one batch, committed or not."""
        return self.parts(table, [self.folder(table, batch)]).select(*schema_of(table).names)

    def stage(self, name: str, batch: int, df: DataFrame, family: str | None = None) -> DataFrame:
        """Write an intermediate frame of a batch and read it back, which cuts its lineage."""
        folder = self.folder(f"staging/{name}", batch)
        writer = df.write.options(**PLAIN).mode("overwrite")
        if family is None:
            writer.parquet(folder)
        else:
            # Without a sort: a task keeps one open file for each of the few families.
            with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):
                writer.partitionBy(family).parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def has_stream_batch(self, stream: str, number: int) -> bool:
        """Whether this micro-batch of this stream is already committed."""
        return any(r.stream == stream and r.stream_batch == number for r in self._commits())

    def commit(self, batch: int, first_seq: int, last_seq: int, stream: str | None = None,
               stream_batch: int | None = None, merged: dict[str, list[int]] | None = None,
               held: dict[str, int] | None = None) -> None:
        """Make the tables that ``write`` wrote for this batch visible, all at once.

        The row also says how many claims the batch made and when, so that pages need not look.
        """
        if last_seq > MAX_SEQ:
            raise ValueError(f"upload number {last_seq} does not fit in an id")
        made = self.spark.range(1).select(
            F.lit(0).cast("long").alias("claims"), *[F.lit(None).cast("timestamp").alias(n)
                                                    for n in ("oldest", "newest")])
        if "claims" in self._written.get(batch, ()):
            made = self.written("claims", batch).agg(
                F.count(F.lit(1)).alias("claims"), F.min("created_at").alias("oldest"),
                F.max("created_at").alias("newest"))
        made.select(
            F.lit(batch).cast("long").alias("batch"),
            F.lit(first_seq).cast("long").alias("first_seq"),
            F.lit(last_seq).cast("long").alias("last_seq"),
            F.array(*[F.lit(t) for t in sorted(self._written.pop(batch, ()))]).cast(
                "array<string>").alias("tables"),
            F.lit(stream).cast("string").alias("stream"),
            F.lit(stream_batch).cast("long").alias("stream_batch"),
            F.current_timestamp().alias("committed_at"),
            _map({t: F.array(*[F.lit(b) for b in old]) for t, old in (merged or {}).items()}).cast(
                "map<string, array<long>>").alias("merged"),
            _map({t: F.lit(n) for t, n in (held or {}).items()}).cast(
                "map<string, long>").alias("held"), "claims", "oldest", "newest"
        ).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        self._delete_staged(batch)

    def _delete_staged(self, batch: int) -> None:
        """Removes what ``stage`` wrote for a batch: nothing reads it after the commit."""
        staging, files = self._hadoop(f"{self.path}/staging/*/batch={batch}")
        for found in files.globStatus(staging) or ():
            files.delete(found.getPath(), True)

    def read(self, table: str, upload_seq: int | None = None,
             batches: list[int] | None = None) -> DataFrame:
        """Committed rows of a table, under its contract; empty before the first commit.

        Given an upload number, only the batch that holds it is read.
        """
        folders = [self.folder(table, r.batch) for r in self.live(table)
                   if (upload_seq is None or r.first_seq <= upload_seq <= r.last_seq)
                   and (batches is None or r.batch in batches)]
        if not folders:
            return self.spark.createDataFrame([], schema_of(table))
        return self.parts(table, folders).select(*schema_of(table).names)

    def parts(self, table: str, folders: list[str], **columns: str) -> DataFrame:
        """Rows in folders of a table, with ``columns`` that its folder names hold."""
        schema = schema_of(table)
        for name, kind in columns.items():
            schema = schema.add(name, kind)
        return self.spark.read.option("basePath", f"{self.path}/{table}").schema(schema).parquet(
            *folders)
