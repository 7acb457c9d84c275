"""Exact deduplication by a stream with disk-backed keyed state.

A file stream over the documents feeds a keyed aggregate whose state lives in RocksDB and never
expires. For each digest of a normalised text the state holds the best document so far (most code
points, then smallest id), its content locator (file and row) and the number of documents. The
state is then read back as a table, each document looks up its digest, and the full bytes of every
hit are compared with those of the document the locator points at. Should two different texts share
a digest, their group is divided by the texts themselves.

Defined results: a null text is an empty text. Rows with a null id come after all others; a group
of only such rows has a null ``keep_id``. Of rows with the same id and length the one whose file
and row come first stays, so one row of a group is kept. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.llm.common import SPACES, scratch, text_of
from remitframe.session import checked_join, checkpointed

# Copies of one text that are compared in one task.
COPIES_PER_TASK = 20_000
# Older files than this, counted from the newest one seen, would be skipped by the file source. Its
# own default is a week; files may come late or keep the times of their originals.
MAX_FILE_AGE = "365000d"
# Digests, with the locators of their documents, that may be sent to every task (a few hundred
# bytes each).
BROADCAST_DIGESTS = 100_000

_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All state stores of an executor share this much memory; the rest is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Many small stores: no preallocated files, and what a batch changed instead of snapshots.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # One pass over what is there now needs no second batch for late rows.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: str | Column) -> Column:
    norm = text_of(text)
    for character in SPACES:
        norm = F.replace(norm, F.lit(character), F.lit(""))   # faster than one pattern
    return norm


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Digest and rank of each row; the smallest rank of a group stays."""
    norm = normalised(text_col)
    return df.select(digest(norm).alias("digest"), F.struct(
        (-F.length(text_of(text_col))).alias("neg_chars"), F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row")).alias("rank"), norm.alias("norm"))


def stream_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                 checkpoint: str | None = None, files_per_batch: int | None = None,
                 digest=text_digest) -> DataFrame:
    """Runs the stream over all files not yet read and returns its state, one row per digest.

    With a ``checkpoint`` of an earlier run the state goes on from there. Columns: ``digest``,
    ``best`` (a rank as in ``_located``) and ``copies``.
    """
    checkpoint = checkpoint or scratch(spark, "dedup-state")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern that only this path matches, it may be one file as well as a folder.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    keyed = _located(reader.parquet(pattern), id_col, text_col, digest).groupBy("digest").agg(
        F.min("rank").alias("best"), F.count(F.lit(1)).alias("copies"))
    before = {k: spark.conf.get(k, None) for k in _STATE_SETTINGS}
    for k, v in _STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (keyed.writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        if not _committed(spark, checkpoint):
            return spark.createDataFrame([], keyed.schema)
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best, copies = state.schema["value"].dataType.names
    return state.select("key.digest", F.col("value")[best].alias("best"),
                        F.col("value")[copies].alias("copies"))


def _committed(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the stream has completed a batch; over no files it runs none."""
    commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return commits.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).exists(commits)


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                checkpoint: str | None = None, files_per_batch: int | None = None,
                copies_per_task: int = COPIES_PER_TASK, digest=text_digest) -> DataFrame:
    """One row per document of the Parquet folder ``path``.

    Columns: ``id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` and the locator ``keep_file``
    and ``keep_row`` of the document that stays.
    """
    state = stream_state(spark, path, id_col, text_col, checkpoint, files_per_batch, digest)
    docs = _located(spark.read.parquet(path), id_col, text_col, digest)
    repeated = checkpointed(state.where("copies > 1"))
    # A document that the stream never read may not go missing without a word.
    missing = F.raise_error(F.concat(F.lit("the state lacks the digest "), F.col("digest"),
                                     F.lit(" of "), F.col("rank.file")))
    found = docs.select("digest", "rank").join(
        state.withColumn("known", F.lit(True)), "digest", "left").select(
        "digest", "rank", "best", F.when(F.col("known"), F.col("copies")).otherwise(
            missing.cast("long")).alias("copies"))

    # Full bytes of all copies against the document that stays. A large group is divided over
    # several tasks; the one text it is compared with is repeated for each of them.
    parts = F.ceil(F.col("copies") / copies_per_task)
    hits = checked_join(docs, repeated, "digest", "inner", BROADCAST_DIGESTS)
    kept = hits.where(F.col("rank") == F.col("best")).select(
        "digest", F.col("norm").alias("kept_norm"),
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    copies = hits.where(F.col("rank") != F.col("best")).select(
        "digest", "norm", F.pmod(F.xxhash64("rank"), parts).alias("part"))
    differing = checkpointed(copies.join(kept, ["digest", "part"]).where(
        "norm <> kept_norm").select("digest").distinct())

    if not differing.isEmpty():
        texts = checked_join(docs, differing, "digest", "left_semi")
        apart = texts.join(texts.groupBy("digest", "norm").agg(
            F.min("rank").alias("best"), F.count(F.lit(1)).alias("copies")), ["digest", "norm"])
        found = checked_join(found, differing, "digest", "left_anti").select(
            "digest", "rank", "best", "copies").unionByName(
            apart.select("digest", "rank", "best", "copies"))
    return found.select(
        F.col("rank.id").alias("id"), F.col("best.id").alias("keep_id"),
        F.col("copies").alias("group_size"), (F.col("rank") == F.col("best")).alias("kept"),
        "digest", F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))
