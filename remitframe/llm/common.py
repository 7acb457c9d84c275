"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.operators.ordinal import with_ordinal
from remitframe.session import shared_dir

# The white space of the contracts: a blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\v\f\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike a cache it survives lost executors, and later passes read only the columns they use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text of a column; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def send_by_value(module: str) -> None:
    """Tasks get the functions of this module with their code: it need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def with_key(docs: DataFrame, id_col: str, text_col: str,
             columns: list[str | Column] | None = None) -> DataFrame:
    """``doc``, a unique long in the order of ids, ``text`` (not null) and further ``columns``.

    Whole-number ids that neither repeat nor miss are the keys themselves. Otherwise rows are
    numbered by id (null last), then text; the ids are then in a column ``id``.
    """
    columns = columns or []
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.groupBy(id_col).count().where(
            (F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs.select(F.col(id_col).cast("long").alias("doc"),
                           text_of(text_col).alias("text"), *columns)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *columns)
    ordered = with_ordinal(rows, [F.col("id").asc_nulls_last(), F.col("text")], "doc")
    return staged(ordered.withColumn("doc", F.col("doc").cast("long")), "ordered")
