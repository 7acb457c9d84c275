"""Dense global numbering without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitframe.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def sorted_partitions(df: DataFrame, order: list, partitions: int | None = None,
                      made: list | None = None,
                      keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Range-partition and sort by ``order``; adds ``part`` (in order) and ``row_in_part``.

    A range split is even whatever the key distribution, as long as ``order`` is close to
    unique: a hot prefix is cut further along. The result is checkpointed, or what ``keep`` does
    instead, because the bounds come from sampling and must not differ between two uses. ``made`` names the columns to keep;
    what they compute is computed behind the sort, once, while sampling would do it twice.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if made is not None:
        laid_out = laid_out.select(*made)
    laid_out = laid_out.withColumn("_mid", F.monotonically_increasing_id())
    return (keep(laid_out)
            .withColumn("part", F.shiftright("_mid", _ROW_BITS))
            .withColumn("row_in_part", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
            .drop("_mid"))


def with_ordinal(df: DataFrame, order: list, name: str, start: int = 0,
                 partitions: int | None = None) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given order."""
    parts = sorted_partitions(df, order, partitions)
    # One row per range partition, so both the window and the broadcast are bounded by the
    # number of partitions, not by the data.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return parts.join(F.broadcast(offsets), "part").select(
        *df.columns, (F.col("_offset") + F.col("row_in_part") + start).alias(name))
