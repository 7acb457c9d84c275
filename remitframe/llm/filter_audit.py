"""How quality filters interact: what each one removes under every order of applying them.

Every document is tested by all filters. Per part (language) and range of ids there is one row with
the sorted ids that fail each filter and those labelled good or toxic: the posting lists. All
figures follow from sizes of unions of these lists. What is gone after some filters is the union of
their lists; what the next one removes is the difference of two unions; what only one filter catches
is the difference between all lists and all others. Unions are sized by a k-way merge that gallops: the
list with the smallest head runs ahead to the next head of another list by doubling steps, and the
run is added to the size without visiting its ids. Sizes are sums over ranges, so no list is ever
needed whole and a part with any share of the documents is divided like any other.

The filters (words are maximal runs without white space, case-sensitive):

* A: under ``MIN_WORDS`` words
* B: distinct words below ``MIN_DISTINCT_PERCENT`` of the words
* C: capitals A to Z above ``MAX_CAPITALS_PERCENT`` of the code points
* D: any of ``#$%&*|``
* E: the same text as a document with a smaller id, anywhere in the table

Texts are read once; from then on a document is its id, part, digest and one number. Of the
digests only those of repeated texts are joined back. Ranges come from a range partitioning, so ids need
not be dense, and a task holds at most ``block`` documents' lists.

Defined results: a null text is empty, a null part is the empty string; null ids are never above or
below another id (they pass E) and have no labels; repeated rows and ids count each, and equal ids are
not smaller; labels of a repeated id count if any of its rows has them; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitframe.llm.common import send_by_value, staged, with_key
from remitframe.session import checked_join

send_by_value(__name__)

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
CAPITALS = bytes(range(0x41, 0x5B))
SYMBOLS = b"#$%&*|"
BLOCK = 131_072
# Rows that may be sent to every task (digests of repeated texts, labelled ids), some 60 bytes each.
BROADCAST_LIMIT = 200_000


def failed_alone(text: str) -> int:
    """Which of A to D a text fails, as bits."""
    stored = text.encode()
    words = stored.split()   # bytes split at just the white space of the contracts
    capitals = len(stored) - len(stored.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS_PERCENT * len(text)) << 2
            | (len(stored.translate(None, SYMBOLS)) < len(stored)) << 3)


def tested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           part_col: str = "lang") -> DataFrame:
    """One row per document: ``doc`` (a unique long in the order of ids), ``id``, ``part``, ``failed``.

    ``failed`` has bit k for the k-th filter.
    """
    keyed = with_key(docs, id_col, text_col, [
        F.struct(F.col(id_col).alias("id"), F.coalesce(
            F.col(part_col).cast("string"), F.lit("")).alias("part")).alias("own")])
    id_type = docs.schema[id_col].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([failed_alone(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())],
                names=["doc", "id", "part", "alone", "digest"])
    alone = staged(keyed.select("doc", "own.id", "own.part", "text").mapInArrow(
        test, f"doc long, id {id_type}, part string, alone int, digest binary"), "tested")
    copies = staged(alone.where("id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(
        "first_id < last_id").select("digest", "first_id"), "copies")
    bit = 1 << FILTERS.index("E")
    return checked_join(alone, copies, "digest", "left", BROADCAST_LIMIT).select(
        "doc", "id", "part", F.when(F.col("id") > F.col("first_id"),
                                    F.col("alone").bitwiseOR(F.lit(bit))).otherwise(
            F.col("alone")).alias("failed"))


def posting_lists(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc, part, failed, good, toxic`` as sorted lists of ``doc`` per part and range.

    Columns: ``part``, ``first_doc``, ``last_doc``, ``n`` (documents), ``failing`` (a list for each
    filter), ``good`` and ``toxic``.
    """
    rows = staged(rows.select("doc", "part", "failed", "good", "toxic"), "flags")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_filters = len(FILTERS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list] = {}
        held = 0

        def out():
            parts = list(lists)
            made = [lists[p] for p in parts]
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array(parts, pa.string()), pa.array([m[0] for m in made], pa.int64()),
                pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                pa.array([m[3] for m in made], pa.list_(longs)),
                pa.array([m[4] for m in made], longs), pa.array([m[5] for m in made], longs)],
                names=["part", "first_doc", "last_doc", "n", "failing", "good", "toxic"])
        for batch in batches:
            for doc, part, failed, good, toxic in zip(*(c.to_pylist() for c in batch.columns),
                                                      strict=True):
                found = lists.get(part)
                if found is None:
                    found = lists[part] = [doc, doc, 0, [[] for _ in range(n_filters)], [], []]
                found[1] = doc
                found[2] += 1
                for k in range(n_filters):
                    if failed >> k & 1:
                        found[3][k].append(doc)
                if good:
                    found[4].append(doc)
                if toxic:
                    found[5].append(doc)
                held += 1
                if held == block:
                    yield out()
                    lists, held = {}, 0
        if lists:
            yield out()
    return rows.repartitionByRange(tasks, "doc").sortWithinPartitions("doc").mapInArrow(
        collect, "part string, first_doc long, last_doc long, n long, "
                 "failing array<array<long>>, good array<long>, toxic array<long>")


def gallop(ids: list[int], start: int, limit: int) -> int:
    """The first place from ``start`` on whose id is not below ``limit``."""
    step, high = 1, start
    while high < len(ids) and ids[high] < limit:
        start = high + 1
        high += step
        step *= 2
    return bisect_left(ids, limit, start, min(high, len(ids)))


def counts_before(ids: list[int], marked: list[int]) -> list[int]:
    """How many of the first k ids are marked, for k from 0."""
    counts, at, n = [0], 0, 0
    for doc in ids:
        if at < len(marked) and marked[at] < doc:
            at = gallop(marked, at, doc)
        n += at < len(marked) and marked[at] == doc
        counts.append(n)
    return counts


def union_sizes(lists: list[list[int]], marks: list[list[list[int]]]) -> list[int]:
    """Size of the union of sorted lists, and of the union's share of each kind of marks."""
    sizes = [0] * (1 + len(marks[0])) if marks else [0]
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    while heads:
        _, k, start = heapq.heappop(heads)
        ids = lists[k]
        end = gallop(ids, start, heads[0][0]) if heads else len(ids)
        sizes[0] += end - start
        for m, counts in enumerate(marks[k], 1):
            sizes[m] += counts[end] - counts[start]
        # An id that another list has at its head is left to that list.
        end += bool(heads) and end < len(ids) and ids[end] == heads[0][0]
        if end < len(ids):
            heapq.heappush(heads, (ids[end], k, end))
    return sizes


def unions(postings: DataFrame) -> DataFrame:
    """``part``, ``filters`` (bits), and how many documents, good and toxic ones fail any of them.

    For no filters, ``n`` counts the part's documents.
    """
    n_filters = len(FILTERS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, n, failing, good, toxic in zip(*(c.to_pylist() for c in batch.columns),
                                                     strict=True):
                out.append((part, 0, n, 0, 0))
                marks = [[counts_before(ids, good), counts_before(ids, toxic)] for ids in failing]
                for chosen in range(1, 1 << n_filters):
                    which = [k for k in range(n_filters) if chosen >> k & 1]
                    out.append((part, chosen, *union_sizes([failing[k] for k in which],
                                                           [marks[k] for k in which])))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 3),
                                                strict=True)],
                names=["part", "filters", "n", "n_good", "n_toxic"])
    sizes = postings.select("part", "n", "failing", "good", "toxic").mapInArrow(
        merge, "part string, filters int, n long, n_good long, n_toxic long")
    return sizes.groupBy("part", "filters").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])


def _terms() -> list[tuple]:
    """What every union adds to the figures of each step of each order.

    (order, step, filter, filters of the union, and its factor in kept, removed, redundant and
    unique_fails). No filters stand for all documents of the part.
    """
    everything = (1 << len(FILTERS)) - 1
    terms = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            after = before | bit
            factors: dict[int, list[int]] = {}
            for figure, union, factor in (
                    (0, 0, 1), (0, after, -1), (1, after, 1), (1, before, -1), (2, bit, 1),
                    (2, after, -1), (2, before, 1), (3, everything, 1),
                    (3, everything ^ bit, -1)):
                if union or not figure:   # the union of no filters removes nothing
                    factors.setdefault(union, [0] * 4)[figure] += factor
            terms += [("".join(order), step, name, union, *f) for union, f in factors.items()]
            before = after
    return terms


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. ``labels`` has ``quality`` and ``toxic`` (1 counts) by ``id_col``.
    """
    rows = tested(docs, id_col, text_col, part_col)
    marked = staged(labels.where("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "marks")
    rows = checked_join(rows, marked, "id", "left", BROADCAST_LIMIT)
    sizes = unions(posting_lists(rows, block))
    terms = docs.sparkSession.createDataFrame(
        _terms(), "filter_order string, step int, filter string, filters int, to_kept int, "
                  "to_removed int, to_redundant int, to_unique int")

    def total(size: str, factor: str):
        return F.sum(F.col(size) * F.col(factor))
    # The terms are a few thousand rows, whatever the tables.
    figures = sizes.join(F.broadcast(terms), "filters").groupBy(
        "part", "filter_order", "step", "filter").agg(
        total("n", "to_kept").alias("kept"), total("n", "to_removed").alias("removed"),
        total("n", "to_redundant").alias("redundant"), total("n", "to_unique").alias("unique_fails"),
        total("n_good", "to_removed").alias("good_lost"),
        total("n_toxic", "to_removed").alias("toxic_lost"))
    return figures.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))
