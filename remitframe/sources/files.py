"""EDI files as DataFrames.

A source yields two frames:

* files  - one row per file: ``upload_seq, file_name, element_sep, component_sep, terminator,
  file_error``.
* blocks - the text of the files in pieces: ``upload_seq, chunk, block_seq, text`` plus the three
  delimiters. A block ends at a segment boundary. ``(chunk, block_seq)`` orders the blocks of a
  file, and a chunk is small enough for one task.

Files of any size are read in byte ranges, each cut at its own file's terminator, so no task ever
holds a whole file and size changes nothing (``ranges.py``). Only where ``pyarrow`` cannot reach the
store, files are read whole, one block each, up to Spark's limit of 2 GB; the tables are the same.

The blocks of a chunk lie in one partition, one after the other: ingest reads them in that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.operators.ordinal import with_ordinal
from remitframe.session import checkpointed, few_listing_tasks
from remitframe.sources import ranges

GLOB = "*.{edi,txt,x12}"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ISA_LENGTH = 106
RANGE_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024
# A task reads at least this much, and small ranges share a few tasks per core.
_LEAST_TASK = 1024 * 1024
_TASKS_PER_CORE = 4
DELIMITERS = ("element_sep", "component_sep", "terminator")


@dataclass(frozen=True)
class Source:
    files: DataFrame
    blocks: DataFrame
    # A folder that holds nothing but these frames' rows, if there is one.
    folder: str | None = None


def decode(content: Column) -> Column:
    """UTF-8 text, or Latin-1 when the bytes are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")),
                      F.decode(content, "ISO-8859-1"))


def file_name_of(path: Column) -> Column:
    """The last part of a path as the ``binaryFile`` source gives it (not encoded)."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")),
                      F.lit("unknown.edi"))


def isa_block(text: Column) -> Column:
    """Text from the first ISA on, cut to the fixed length of that segment; null without ISA."""
    at = F.locate("ISA", text)
    return F.when(at > 0, F.substring(text, at, F.lit(ISA_LENGTH)))


def with_delimiters(files: DataFrame, isa: Column | None = None) -> DataFrame:
    """Add the delimiters an ISA segment declares, or the error that keeps a file out."""
    isa = isa_block(F.col("raw_text")) if isa is None else isa
    usable = F.length(isa) >= ISA_LENGTH

    def at(i):
        return F.when(usable, F.substring(isa, i + 1, 1))
    return files.withColumns({
        "element_sep": at(3), "component_sep": at(104), "terminator": at(105),
        "file_error": F.when(isa.isNull(), F.lit("No ISA segment found in EDI file")).when(
            ~usable, F.concat(F.lit("ISA segment too short ("), F.length(isa).cast("string"),
                              F.lit(f" chars, need {ISA_LENGTH})")))})


def upload_order(files: DataFrame) -> DataFrame:
    """Number files from 1 by (modificationTime, path), without bringing them to one task."""
    return with_ordinal(files, ["modificationTime", "path"], "upload_seq", 1)


def from_binary(files: DataFrame) -> Source:
    """Source from whole-file rows that already carry ``upload_seq``."""
    decoded = with_delimiters(files.select(
        "upload_seq", file_name_of(F.col("path")).alias("file_name"),
        decode(F.col("content")).alias("raw_text")))
    return Source(
        decoded.drop("raw_text"),
        decoded.where("file_error is null").select(
            "upload_seq", F.lit(0).cast("long").alias("chunk"),
            F.lit(0).cast("long").alias("block_seq"), F.col("raw_text").alias("text"),
            *DELIMITERS))


def listing_of(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """Path, time and length of the files below a folder. No content is read."""
    with few_listing_tasks(spark):
        return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
                .format("binaryFile").load(path).select("path", "modificationTime", "length"))


def read_edi(spark: SparkSession, path: str, glob: str = GLOB, range_bytes: int = RANGE_BYTES,
             block_bytes: int = BLOCK_BYTES) -> Source:
    """EDI files of any size, in either charset and with any delimiters."""
    if ranges.can_read(path):
        return from_listing(listing_of(spark, path, glob), range_bytes, block_bytes)
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return from_whole(reader.format("binaryFile").load(path))


def from_whole(content: DataFrame) -> Source:
    """Source from unnumbered whole-file rows. Only paths and times are sorted, not the contents."""
    seqs = upload_order(content.select("path", "modificationTime"))
    # This side holds only path and number; adaptive execution broadcasts it when its measured
    # size is small.
    return from_binary(content.select("path", "content").join(
        seqs.select("path", "upload_seq"), "path"))


def range_tasks(size: int, ranges_count: int, cores: int, range_bytes: int) -> int:
    """How many tasks read ``size`` bytes: about one full range each, or many small ones.

    Every task writes files of its own, so small ranges must not mean many tasks: they are a few per
    core until each reads 64 MB. Few files still use all cores.
    """
    share = min(max(size // (_TASKS_PER_CORE * cores), _LEAST_TASK), RANGE_BYTES)
    return max(-(-size // max(range_bytes, share)), min(ranges_count, cores), 1)


def from_listing(listing: DataFrame, range_bytes: int = RANGE_BYTES,
                 block_bytes: int = BLOCK_BYTES) -> Source:
    """Source from a listing of files (``path, modificationTime, length``), read range by range."""
    numbered = upload_order(listing).select("upload_seq", "path", "length")
    cut = numbered.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)),
        F.lit(range_bytes).cast("long"))).alias("start")).withColumn(
        "end", F.least(F.col("start") + range_bytes, F.col("length")))
    size, n = cut.agg(F.sum(F.col("end") - F.col("start")), F.count(F.lit(1))).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = range_tasks(size or 0, n, cores, range_bytes)
    heads = ranges.heads(cut.repartition(tasks), chars=ISA_LENGTH).groupBy("upload_seq").agg(
        F.bool_and("utf8").alias("utf8"), F.min_by("head", "head_at").alias("head"))
    head = F.when(F.col("utf8"), F.col("head").cast("string")).otherwise(
        F.decode("head", "ISO-8859-1"))
    files = checkpointed(with_delimiters(
        numbered.join(heads, "upload_seq"), F.substring(head, 1, ISA_LENGTH)).select(
        "upload_seq", file_name_of(F.col("path")).alias("file_name"), "utf8", *DELIMITERS,
        "file_error"))
    # Ranges get to their tasks before any text is read.
    readable = cut.join(files.where("file_error is null").select(
        "upload_seq", "utf8", *DELIMITERS), "upload_seq").repartition(tasks)
    blocks = ranges.blocks(readable, block_bytes).withColumn("block_seq", F.lit(0).cast("long"))
    return Source(files.drop("utf8"), blocks)
