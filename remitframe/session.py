"""Session-level helpers: the shared checkpoint folder and size-checked joins."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in rows, that may be sent to every executor. At the widest row joined this way
# (a few hundred bytes) this is well under Spark's own 8 GB broadcast limit.
BROADCAST_ROWS = 1_000_000
# A key with more rows than this is spread over several tasks in ``split_join``.
HOT_ROWS = 1_000_000
# Of Parquet files: two thirds of the space that Spark's default takes, in the same time.
COMPRESSION = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
# For frames that are read only once or twice: to look for equal values takes longer than to compress them.
PLAIN = {**COMPRESSION, "parquet.enable.dictionary": "false"}
# ``kept_in_files`` writes files of 2**17 rows, each as one row group, which no two tasks share.
FILE_BITS = 17
_ROW_GROUP = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where every executor
    is this machine, may fall back on a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="remitframe-"))
    return configured or sc.getCheckpointDir()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_methods(spark: SparkSession):
    """For plans whose generated code is one huge method, which the JVM would not compile.

    Beyond the JVM's limit of 8000 bytes Spark then generates several methods instead.
    """
    return setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def few_listing_tasks(spark: SparkSession):
    """Folders are listed in a few tasks per core; by default each folder is a task of its own."""
    return setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism",
                   str(4 * spark.sparkContext.defaultParallelism))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_in_files(df: DataFrame, folder: str) -> DataFrame:
    """Like ``checkpointed``, compressed and in a folder that can be deleted.

    The rows of each task lie in files of ``1 << FILE_BITS`` rows. A file is read by one task, in the
    order it was written.
    """
    df.write.options(**PLAIN).option("maxRecordsPerFile", 1 << FILE_BITS).option(
        "parquet.block.size", _ROW_GROUP).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Lets executors delete the shuffle files of frames that are done with.

    Spark does so once the driver's memory is cleaned up, which it may put off for half an hour.
    """
    spark.sparkContext._jvm.System.gc()


def many_scan_tasks(spark: SparkSession):
    """Small files are read in a few tasks per core; by default in about one, so that one core may be
    left with twice the work of the others."""
    return setting(spark, "spark.sql.files.minPartitionNum",
                   str(4 * spark.sparkContext.defaultParallelism))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows. Reads no more than ``limit + 1`` of them."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def checked_join(big: DataFrame, small: DataFrame, on, how: str,
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` when its counted size allows, else a shuffle join.

    In the shuffle case adaptive execution splits hot partitions of ``big``. ``small`` should be
    a stored or checkpointed frame, because counting it is an action.
    """
    if fits_broadcast(small, limit):
        small = F.broadcast(small)
    return big.join(small, on, how)


def split_join(left: DataFrame, right: DataFrame, key: str, spread: str,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join in which a hot key of ``left`` is divided by the values of ``spread``.

    For joins that adaptive execution cannot divide, because ``right`` reaches them without an
    exchange of its own. ``right`` has one row per key. The rows of a hot key get one of several
    salts, and its single right row is repeated once per salt, so the result is the same. There
    are at most (rows of ``left``) / ``hot_rows`` hot keys.
    """
    hot = checkpointed(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > hot_rows).select(key, F.ceil(F.col("_n") / hot_rows).alias("_parts")))
    if hot.isEmpty():
        return left.join(right, key)
    salted = checked_join(left, hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    repeated = checked_join(right, hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                      F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
