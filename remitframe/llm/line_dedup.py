"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line that stands on more than ``ratio`` of the pages of its host, and
on at least ``min_pages`` of them, is boilerplate and is dropped from all pages of that host. Lines
are compared without white space at their ends; lines without a word are neither counted nor
dropped, and a line counts once per page.

Only digests of lines are shuffled: counts are combined before the shuffle, so one very common line
or one very large host is no hot spot. The boilerplate lines come back to the pages as one list
per host when a count shows that they are few, and otherwise through a join by line and a list per
page; texts stay where they are in the first case.

Defined results: a null or empty text is a text without lines to drop; a null host is a host of its
own; repeated rows are separate pages; an empty table gives an empty result. Extra columns are
kept unless they have the name of an added column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import SPACE, staged, text_of
from remitframe.session import BROADCAST_ROWS, fits_broadcast

# Shares of a host's pages; on small hosts the least number of pages is what guards single copies.
RATIO = 0.01
MIN_PAGES = 3
_KEY = "_line_dedup"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")


def _digests(text: Column) -> Column:
    """Digest of each line, empty for a line without a word."""
    def digest(line):
        trimmed = _trimmed(line)
        return F.when(trimmed == "", "").otherwise(F.sha2(trimmed, 256))
    return F.transform(F.split(text, "\n", -1), digest)


def _host(host_col: str | Column) -> Column:
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    # One character tells a null host from a host of any name.
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def boilerplate_lines(pages: DataFrame, text_col: str = "text",
                      host_col: str | Column = "source", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES) -> DataFrame:
    """Hosts (marked, see ``_host``), digests and page counts of the lines to drop."""
    lines = pages.select(_host(host_col).alias("host"), F.explode(F.array_remove(
        F.array_distinct(_digests(text_of(text_col))), "")).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(
        F.col("pages") >= min_pages)
    totals = pages.groupBy(_host(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("host_pages"))
    return often.join(totals, "host").where(F.col("pages") > F.col("host_pages") * F.lit(ratio))


def drop_boilerplate(pages: DataFrame, text_col: str = "text", host_col: str | Column = "source",
                     ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, plus ``n_lines`` and ``n_dropped`` (long)."""
    dropped = staged(boilerplate_lines(pages, text_col, host_col, ratio, min_pages),
                     "boilerplate").select("host", "line")
    marked = pages.withColumn(f"{_KEY}_host", _host(host_col)).withColumn(
        f"{_KEY}_lines", _digests(text_of(text_col)))
    if fits_broadcast(dropped, broadcast_rows):
        # At most ``broadcast_rows`` digests of 64 characters in all lists together.
        lists = dropped.groupBy(F.col("host").alias(f"{_KEY}_host")).agg(
            F.collect_list("line").alias(f"{_KEY}_all"))
        joined = marked.join(F.broadcast(lists), f"{_KEY}_host", "left").withColumn(
            f"{_KEY}_bad", F.array_intersect(f"{_KEY}_lines", f"{_KEY}_all"))
    else:
        marked = staged(marked.withColumn(f"{_KEY}_row", F.monotonically_increasing_id()),
                        "lines")
        per_page = marked.select(
            f"{_KEY}_row", F.col(f"{_KEY}_host").alias("host"),
            F.explode(F.array_distinct(f"{_KEY}_lines")).alias("line")).join(
            dropped, ["host", "line"]).groupBy(f"{_KEY}_row").agg(
            F.collect_list("line").alias(f"{_KEY}_bad"))
        joined = marked.join(per_page, f"{_KEY}_row", "left")
    digests, bad = F.col(f"{_KEY}_lines"), F.col(f"{_KEY}_bad")
    lines = F.split(text_of(text_col), "\n", -1)
    hit = F.coalesce(F.size(bad) > 0, F.lit(False))
    left = F.filter(lines, lambda line, i: ~F.array_contains(bad, F.get(digests, i)))
    n_dropped = F.when(hit, F.size(F.filter(digests, lambda d: F.array_contains(bad, d))))
    cleaned = F.when(hit, F.array_join(left, "\n")).otherwise(F.col(text_col))
    keep = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.size(F.filter(digests, lambda d: d != "")).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"))
