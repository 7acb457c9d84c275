"""Best-fit packing of tokenised documents with a fixed number of open bins.

A document is cut only where it is longer than a sequence; each piece goes, in the order of arrival,
into the open bin with the least free space that still takes it. Bins are found in a bitset keyed by
free space: bit f is set while an open bin has f tokens free, so the best bin for n tokens is the
lowest set bit from n on. If no bin takes a piece and all ``open_bins`` are in use, the fullest one
(the lowest set bit) closes for a new one. A full bin closes at once. Of bins with equal space the
one that got it first is taken.

Each task packs the documents that it tokenises, so nothing is shuffled for that. The bins still
open at a task's end are left over: their pieces, a few hundred a task, are dealt out evenly to
as few tasks as hold ``task_tokens`` tokens each and packed again in the same way, and so on, until one
task takes all that is left. A round leaves at most ``open_bins`` sequences a task, so the rounds are
few (the logarithm of the input), the last task is bounded by ``task_tokens``, and no more than
``open_bins`` sequences of the whole result are open at its end. A task holds its open bins and one
batch. Each round is staged, so a lost executor repeats tasks of one round only.

Token ids are those of the tokenizer file. Its words never reach across the white space of the
contracts, so a text is the sequence of its blank-free strings, each tokenised once by a Python
worker and remembered (as many as ``_REMEMBERED``, then anew).

Defined results: a null or empty text has the end id alone; repeated rows and ids are packed each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import scratch, send_by_value, text_of

send_by_value(__name__)

LENGTH = 2048
OPEN_BINS = 64
TASK_TOKENS = 8_000_000
END_ID = 0
# Strings and words whose ids a Python worker keeps (some 200 MB), and the longest of them.
_REMEMBERED, _LONGEST = 1_000_000, 64
# Bytes of text that are split at once, and rows that are sent on at once.
_AT_ONCE, _ROWS = 1_000_000, 4096
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Letters with one lower-case form and one spelling, and ASCII punctuation behind them; an apostrophe
# could start a word's ending.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# Byte-level vocabularies write each byte as a visible character: itself, or one from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)) - set(_VISIBLE)))}


class Tokens(dict):
    """Ids of texts by a ``tokenizers`` file, four bytes each.

    The entries are those of blank-free strings. A string of simple letters and the punctuation behind
    them are words of their own, so they go to the model directly, each once; any other string takes
    the tokenizer's full way.
    """

    def __init__(self, tokenizer_file: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        # Bytes are split at just the blanks of the contracts.
        return b"".join([b"".join(map(self.__getitem__, part.split()))
                         for part in self._parts(text.encode())])

    @staticmethod
    def _parts(text: bytes) -> Iterator[bytes]:
        """The text in parts of bounded size, cut at blanks where there are any."""
        start = 0
        while start < len(text):
            blank = _BLANK.search(text, start + _AT_ONCE)
            end = blank.start() if blank else len(text)
            yield text[start:end]
            start = end

    def __missing__(self, string: bytes) -> bytes:
        if len(self) + len(self.words) >= _REMEMBERED:
            self.clear()
            self.words.clear()
        text = string.decode()
        simple = _SIMPLE.fullmatch(text)
        if simple:
            ids = self._word(simple[1].lower())
            if simple[2]:
                ids += self._word(simple[2])
        else:
            ids = self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(string) <= _LONGEST:
            self[string] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
            ids = self._ids([token.id for token in self.model.tokenize(shown)])
            if len(word) <= _LONGEST:
                self.words[word] = ids
        return ids

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


def kept_tokens(tokenizer_file: str) -> Tokens:
    """A Python worker serves many tasks; what it has learnt is kept for the next one."""
    kept = sys.modules.setdefault("remitframe_kept_tokens", ModuleType("remitframe_kept_tokens"))
    if getattr(kept, "file", None) != tokenizer_file:
        kept.file, kept.tokens = tokenizer_file, Tokens(tokenizer_file)
    return kept.tokens


class OpenBins:
    """Bins with room, at most ``limit`` of them, found by the least space that suffices."""

    def __init__(self, length: int, limit: int, first_id: int):
        self.length, self.limit, self.next_id = length, limit, first_id
        self.spaces = 0                                      # bit f: an open bin has f free
        self.by_space: dict[int, deque[tuple[int, list]]] = {}
        self.n_open = 0

    def _take(self, space: int) -> tuple[int, list]:
        waiting = self.by_space[space]
        found = waiting.popleft()
        if not waiting:
            del self.by_space[space]
            self.spaces ^= 1 << space
        self.n_open -= 1
        return found

    def put(self, size: int, item) -> Iterator[tuple[int, list]]:
        """Places an item; gives the bins that close by it, as (id, [(offset, item), ...])."""
        room = self.spaces >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            number, items = self._take(space)
        else:
            if self.n_open == self.limit and size < self.length:
                yield self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, number, items = self.length, self.next_id, []
            self.next_id += 1
        items.append((self.length - space, item))
        if size == space:
            yield number, items
            return
        self.by_space.setdefault(space - size, deque()).append((number, items))
        self.spaces |= 1 << (space - size)
        self.n_open += 1

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.n_open:
            yield self._take((self.spaces & -self.spaces).bit_length() - 1)


def _packed(items: Iterator[tuple[int, tuple]], id_type: pa.DataType, length: int, open_bins: int,
            first_id: int, last: bool, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the bins as they close; those open at the end are marked unless it is the last."""
    bins = OpenBins(length, open_bins, first_id)
    rows: list[tuple] = []

    def bin_rows(number, placed, left):
        rows.extend((*item, number, offset, left) for offset, item in placed)

    def batch():
        columns = list(zip(*rows, strict=True))
        types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                 *[pa.binary()] * with_ids, pa.int64(), pa.int64(), pa.bool_()]
        names = ["id", "piece", "start", "length", "ids_crc32", *["packed_ids"] * with_ids,
                 "sequence_id", "offset", "left"]
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    for size, item in items:
        for number, placed in bins.put(size, item):
            bin_rows(number, placed, False)
        if len(rows) >= _ROWS:
            yield batch()
    for number, placed in bins.rest():
        bin_rows(number, placed, not last)
    if rows:
        yield batch()


def _staged(rows: DataFrame, name: str) -> DataFrame:
    """Written once, what is left apart from what is done."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.partitionBy("left").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def pack_best_fit(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id",
                  text_col: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS,
                  task_tokens: int = TASK_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents.

    Columns: ``id``, ``piece`` (from 0), ``start`` and ``length`` in the document's ids,
    ``ids_crc32``, ``sequence_id``, ``offset`` in the sequence, and ``ids`` (array) if asked for.
    """
    if length < 1 or open_bins < 1 or task_tokens < 2 * open_bins * length:
        raise ValueError("task_tokens must hold the open bins twice")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {id_type}, piece int, start long, length long, ids_crc32 long, "
              + "packed_ids binary, " * with_ids + "sequence_id long, offset long, left boolean")

    def first_id(round_number: int) -> int:
        from pyspark import TaskContext
        return (round_number << 56) | (TaskContext.get().partitionId() << 32)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        tokens = kept_tokens(tokenizer_file)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                row, ids = row.as_py(), tokens.of(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at:at + 4 * length]
                    size = len(part) // 4
                    yield size, (row, piece, at // 4, size, zlib.crc32(part),
                                 *[part] * with_ids)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield item[3], item

    def packing(items: Callable, round_number: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return

            def all_batches():
                yield first
                yield from batches
            yield from _packed(items(all_batches()), first.schema.field(0).type, length,
                               open_bins, first_id(round_number), last, with_ids)
        return run
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        packing(tokenise, 0, False), schema)
    done, round_number = None, 0
    while True:
        kept = _staged(rows, f"bins-{round_number}")
        closed = kept.where("not left")
        done = closed if done is None else done.unionByName(closed)
        left = kept.where("left").drop("sequence_id", "offset", "left")
        tokens = left.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        tasks = -(-tokens // task_tokens)
        round_number += 1
        # The check value puts the pieces into an order that has nothing to do with their sizes.
        rows = left.repartition(tasks).sortWithinPartitions("ids_crc32", "id", "piece").mapInArrow(
            packing(again, round_number, tasks == 1), schema)
        if tasks == 1:
            done = done.unionByName(rows)
            break
    done = done.drop("left")
    return _with_ids(done, id_type) if with_ids else done


def _with_ids(rows: DataFrame, id_type: str) -> DataFrame:
    """The stored ids as an array."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("packed_ids")
            ids = [np.frombuffer(b.as_py(), "<u4").astype("<i4") for b in batch.column(place)]
            kept = [n for n in batch.schema.names if n != "packed_ids"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(ids, pa.list_(pa.int32()))],
                names=[*kept, "ids"])
    return rows.mapInArrow(unpack, (
        f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, "
        "offset long, ids array<int>"))
