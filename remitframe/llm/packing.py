"""Mixture-controlled packing of tokenised documents into fixed sequences.

Each source is a queue of tokens. A window of ``window`` tokens is filled by deficit round-robin:
every queue earns its target proportion of the window, takes what it has earned in whole tokens,
and carries the unused fraction (its deficit) to the next window. What a queue has taken after k
windows is therefore floor(k * window * share), whichever task holds its documents. So no task waits
for another: a document needs the place where it starts in its queue, and from that all its pieces
follow by arithmetic, including the deficits carried over window and partition borders. By default
the shares are those of the corpus, so all queues end together and every window keeps the mixture
to within one token a source.

Given other target weights, a queue that ends early leaves its place to the others, whose windows
get shorter but keep the targets among themselves.

Windows lie one after the other and are cut every ``length`` tokens, at documents' insides too. The
last tokens, too few for a sequence, make sequences of falling powers of two, so nothing is padded.

Documents are tokenised once; the ids are staged as two bytes each (four for larger vocabularies).
The start of a document in its queue is its place in its task plus the sums of earlier tasks, a
small table by task and source. Texts and ids are never shuffled by source; a source with a third of
all rows is spread as the input is.

Defined results: a null or empty text has only the end id; a null source is a queue of its own;
repeated rows are packed each; an empty table gives an empty result; other columns are not read.
The number of queues has to fit in a task's memory (some bytes each).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitframe.llm.common import send_by_value, staged, text_of
from remitframe.session import checked_join

send_by_value(__name__)

LENGTH = 1024
SEQUENCES_PER_WINDOW = 64
END_ID = 0
# Texts tokenised at once, in characters.
_CHUNK = 1_000_000


class _Tokenizer:
    """Ids of a ``tokenizers`` file, by the faster ``tiktoken`` where a rank file is given.

    Both split and merge alike. A text that holds the string of a special token, or that tiktoken
    refuses, goes to ``tokenizers``.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None):
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file:
            import base64

            import tiktoken
            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as refused:   # a panic of its Rust code is no Exception
                if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


def _tokenised(docs: DataFrame, id_col: str, text_col: str, queue_col: str, tokenizer_file: str,
               ranks_file: str | None, pattern: str | None) -> DataFrame:
    """Ids per document with its task and its place among the task's tokens of its queue."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        tokenizer = _Tokenizer(tokenizer_file, ranks_file, pattern)
        places: dict[str, int] = {}
        for batch in batches:
            out: dict[str, list] = {"row": [], "queue": [], "place": [], "n": [], "ids": []}
            size = 0
            for k in range(batch.num_rows):
                ids = np.array([*tokenizer.ids(batch.column(1)[k].as_py()), END_ID], "<u4")
                queue = batch.column(2)[k].as_py()
                place = places.get(queue, 0)
                places[queue] = place + len(ids)
                for name, value in zip(out, (k, queue, place, len(ids), _packed(ids)),
                                       strict=True):
                    out[name].append(value)
                size += len(ids)
                if size > _CHUNK or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(out["row"])),
                        pa.array(out["queue"], pa.string()), pa.array([task] * len(out["n"]),
                                                                      pa.int64()),
                        pa.array(out["place"], pa.int64()), pa.array(out["n"], pa.int64()),
                        pa.array(out["ids"], pa.binary())],
                        names=["id", "queue", "task", "place", "n", "ids"])
                    out, size = {name: [] for name in out}, 0
    # One character tells a null queue from one of any name.
    queue = F.coalesce(F.concat(F.lit("q"), F.col(queue_col).cast("string")), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"),
                       queue.alias("queue")).mapInArrow(
        encode, f"id {id_type}, queue string, task long, place long, n long, ids binary")


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id behind a zero byte, or four behind a one if the vocabulary needs it."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        return b"\1" + ids.astype("<u4").tobytes()
    return b"\0" + ids.astype("<u2").tobytes()


def _unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u4" if stored[0] else "<u2", offset=1)


class Schedule:
    """Where each queue's tokens go: all of deficit round-robin in closed form.

    ``totals`` are tokens by queue, ``weights`` the targets (whole numbers, above zero).
    """

    def __init__(self, totals: list[int], weights: list[int], length: int, window: int):
        self.totals, self.weights = totals, weights
        self.length, self.window = length, window
        self.weight_sum = sum(weights)
        total = sum(totals)
        self.full = total // length          # sequences of full length
        self.tail_starts, self.tail_sizes = [], []
        at, rest = self.full * length, total % length
        while rest:
            size = 1 << (rest.bit_length() - 1)
            self.tail_starts.append(at)
            self.tail_sizes.append(size)
            at, rest = at + size, rest - size
        self.window_start = lru_cache(4096)(self._window_start)

    def taken(self, queue: int, k: int) -> int:
        """Tokens of a queue that lie in the first k windows."""
        return min(self.totals[queue], k * self.window * self.weights[queue] // self.weight_sum)

    def window_of(self, queue: int, place: int) -> int:
        return ((place + 1) * self.weight_sum - 1) // (self.window * self.weights[queue])

    def _window_start(self, k: int) -> np.ndarray:
        """For each queue, where its tokens of window k start among all tokens."""
        now = np.array([self.taken(i, k) for i in range(len(self.totals))], dtype=np.int64)
        then = np.array([self.taken(i, k + 1) for i in range(len(self.totals))], dtype=np.int64)
        return now.sum() + np.concatenate(([0], np.cumsum(then - now)[:-1])).astype(np.int64)

    def pieces(self, queue: int, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of the n tokens at a place of a queue."""
        start = 0
        while start < n:
            k = self.window_of(queue, place + start)
            here = min(n, self.taken(queue, k + 1) - place)
            at = int(self.window_start(k)[queue]) + place + start - self.taken(queue, k)
            while start < here:
                sequence, offset, size = self._sequence(at)
                step = min(here - start, size - offset)
                yield start, step, sequence, offset
                start, at = start + step, at + step

    def _sequence(self, at: int) -> tuple[int, int, int]:
        if at < self.full * self.length:
            return at // self.length, at % self.length, self.length
        k = bisect_right(self.tail_starts, at) - 1
        return self.full + k, at - self.tail_starts[k], self.tail_sizes[k]


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None,
         pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         queue_col: str = "source", weights: dict[str | None, int] | None = None,
         length: int = LENGTH, sequences_per_window: int = SEQUENCES_PER_WINDOW,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents.

    Columns: ``id``, ``start`` and ``length`` in the document's ids, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence, ``queue``, and ``ids`` (array) if asked for.
    ``weights`` gives targets by source; sources without one weigh 1. Without it the targets are
    the sources' shares of all tokens. A window is lengthened to 64 tokens a queue if need be.
    """
    tokens = staged(_tokenised(docs, id_col, text_col, queue_col, tokenizer_file, ranks_file,
                               pattern), "tokens")
    by_task = staged(tokens.groupBy("queue", "task").agg(F.sum("n").alias("n")), "queue-sums")
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = by_task.select("queue", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(
        "before"))
    # One row per queue, which every task needs whole.
    queues = by_task.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    names = {row["queue"]: k for k, row in enumerate(queues)}
    totals = [row["n"] for row in queues]
    targets = totals if weights is None else [
        weights.get(q[1:] if q else None, 1) for q in names]
    window = max(length * sequences_per_window, 64 * max(len(names), 1))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(totals, targets, length, window)
        for batch in batches:
            rows, out = [], [[] for _ in range(7)]
            pieces_ids = []
            for k in range(batch.num_rows):
                queue, place, n = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                ids = _unpacked(batch.column(4)[k].as_py())
                for start, size, sequence, offset in schedule.pieces(names[queue], place, n):
                    part = ids[start:start + size].astype("<u4")
                    rows.append(k)
                    for column, value in zip(out, (start, size, zlib.crc32(part.tobytes()), n,
                                                   sequence, offset, queue), strict=True):
                        column.append(value)
                    if with_ids:
                        pieces_ids.append(part.astype("<i4"))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())),
                      *[pa.array(c, pa.int64()) for c in out[:6]],
                      pa.array([q[1:] if q else None for q in out[6]], pa.string())]
            if with_ids:
                arrays.append(pa.array(pieces_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[
                "id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                "queue", *["ids"] * with_ids])
    placed = checked_join(tokens, starts, ["queue", "task"], "left").select(
        "id", "queue", (F.col("place") + F.col("before")).alias("place"), "n", "ids")
    return placed.mapInArrow(cut, (
        f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, queue string" + ", ids array<int>" * with_ids))
