"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Each byte covered by a string of ``length`` bytes that also starts earlier (in a document with a
smaller id, or earlier in the same one) is removed; strings are judged on the input. Sorting all
suffixes of a corpus is out of reach, so only those are sorted that can have an equal, one bucket
at a time:

1. Every string of ``length`` bytes has an anchor, its smallest hash of ``GRAM`` bytes (leftmost of
   equals). Equal strings have equal anchors at equal places, so strings fall into buckets by
   anchor. Runs of neighbouring starts share an anchor, one for about 39 bytes. Anchors are dealt
   out by hash, and a task tells which occur more than once.
2. Documents with such anchors give the runs' contexts (the bytes of all strings of a run). They
   are dealt out by anchor. A bucket is then worked on alone: equal contexts are set aside, and the
   suffixes of the differing ones are sorted to the depth ``length``. They are laid out with their
   anchors at multiples of ``COVER``. The strings at the places of a difference cover are ranked
   first; a suffix is then ordered by the rank at the next cover place, which resolves long
   ties, and by the few bytes the rank leaves out. Strings whose hash no other has are left out of the
   sort; what counts as equal is decided by bytes.
3. All but the first of each class of equal strings go back to their documents as runs of starts.

What occurs often in one Arrow batch leaves it once. An anchor with over ``hot_contexts`` contexts
would still be too much for a task: its strings are dealt out singly, by 128-bit hashes, and there, and
only there, equal hashes count as equal strings. The list of such anchors is shorter than (all anchors) / ``hot_contexts``.

Defined results: a null text is empty; rows with a null id come after all others; rows with the
same id are ordered by their text, then arbitrarily (they are then equal); an empty table gives an
empty result; other columns are not read. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import send_by_value, staged, with_key

send_by_value(__name__)

LENGTH = 100
GRAM = 24
COVER = 32
HOT_CONTEXTS = 500_000
# Text per sorting task, in bytes.
TASK_BYTES = 64 << 20
# Buckets that a task sorts, one at a time; it holds one of them at once.
_BUCKETS_PER_TASK = 16
# Bytes whose anchors are computed at once.
_PIECE = 1 << 19
# Contexts whose suffixes are sorted at once; an anchor with more is done in slices, as equal
# strings lie equally far before their anchors.
_BLOCK = 10_000

_RANDOM = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(20)


def _powers(base: int) -> dict[int, np.uint64]:
    return {1 << k: np.uint64(pow(base, 1 << k, 2**64)) for k in range(20)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, joined from those of powers of two."""
    power, known = _powers(base), {1: _RANDOM[data]}
    n = 1
    while 2 * n <= size:
        half = known[n]
        known[2 * n] = half[:-n] * power[n] + half[n:]
        n *= 2
    h, done = known[n], n
    for part in sorted(known, reverse=True):
        if size - done >= part:
            count = len(data) - (done + part) + 1
            h = h[:count] * power[part] + known[part][done:done + count]
            done += part
    return _mixed(h)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of starts with the same anchor: hash, anchor, first start, number of starts.

    ``data`` holds texts one after the other, which end at ``ends``; at most 2^20 bytes.
    """
    grams = length - gram + 1
    if len(data) < length:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    hashes = gram_hashes(data, gram)
    low = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if grams > width:
        low = np.minimum(low[:len(low) - (grams - width)], low[grams - width:])
    places = (low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(places)]
    valid = np.arange(len(places)) + length <= ends[text]
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(places))
    good = valid[first]
    first, count = first[good], count[good]
    at = places[first]
    return hashes[at], at, first, count


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Texts in pieces of bounded size: bytes, ends, and (text, offset in it) of each part.

    Long texts are cut where only their own length decides; parts overlap by ``length - 1``.
    """
    parts, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[at:at + _PIECE + length - 1]
            if held and held + len(part) > 2 * _PIECE - length:
                yield _piece(parts)
                parts, held = [], 0
            if len(part) >= length:
                parts.append((part, (k, at)))
                held += len(part)
    if parts:
        yield _piece(parts)


def _piece(parts):
    data = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
    return data, np.cumsum([len(p) for p, _ in parts]), [place for _, place in parts]


def text_anchors(texts: list[bytes], length: int, gram: int):
    """For each piece: hash, text number, and anchor, first start and count in the text."""
    for data, ends, places in _pieces(texts, length):
        hashes, at, first, count = anchors(data, ends, length, gram)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends[:-1]))[part]
        number = np.array([k for k, _ in places], np.int64)[part]
        offset = np.array([o for _, o in places], np.int64)[part] - begin
        yield hashes, number, at + offset, first + offset, count


def difference_cover(size: int) -> list[int]:
    """Places below ``size`` whose differences take every value modulo ``size``."""
    step = int(np.ceil(np.sqrt(size)))
    return sorted({*range(step), *range(step - 1, size, step)})


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Ranks of rows of bytes in their order."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    ranked = words[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    ranks = np.empty(len(rows), np.uint64)
    ranks[order] = np.cumsum(new).astype(np.uint64)
    return ranks


def repeated_starts(contexts: list[tuple[int, int, int, int, bytes]], length: int):
    """Of strings of ``length`` bytes in contexts, those equal to an earlier one.

    A context is (document, first start, anchor's place in it, number of starts, bytes). Returns
    documents and starts. Contexts of equal strings have to be among those given.
    """
    short = length - COVER            # depth of the cover's ranks
    cover = difference_cover(COVER)
    is_cover = np.zeros(COVER, bool)
    is_cover[cover] = True
    # Lay out the contexts with anchors at multiples of the cover's period.
    layout, at = [], 0
    for _, _, anchor, _, data in contexts:
        at += (-(at + anchor)) % COVER
        layout.append(at)
        at += len(data)
    text = np.zeros(at + length + COVER, np.uint8)
    for place, (_, _, _, _, data) in zip(layout, contexts, strict=True):
        text[place:place + len(data)] = np.frombuffer(data, np.uint8)
    counts = np.array([c[3] for c in contexts])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.array(layout), counts) + within
    docs = np.repeat(np.array([c[0] for c in contexts], np.int64), counts)
    places = np.repeat(np.array([c[1] for c in contexts], np.int64), counts) + within
    # A string without another of its hash has no equal; only the others are sorted, and compared.
    hashes = gram_hashes(text[:at], length)[starts]
    by_hash = np.argsort(hashes)
    twin = hashes[by_hash][1:] == hashes[by_hash][:-1]
    shared = np.zeros(len(starts), bool)
    shared[by_hash[1:][twin]] = True
    shared[by_hash[:-1][twin]] = True
    if not shared.any():
        return docs[:0], places[:0]
    starts, docs, places = starts[shared], docs[shared], places[shared]
    # The next cover place at or after each start is near.
    gap = np.array([next(g for g in range(COVER) if is_cover[(r + g) % COVER])
                    for r in range(COVER)])[starts % COVER]
    samples, of_start = np.unique(starts + gap, return_inverse=True)
    strings = np.lib.stride_tricks.sliding_window_view
    ranks = _ranks(strings(text, short)[samples])[of_start]
    # What the rank leaves out: the bytes before the cover place and the last ones.
    heads = strings(text, COVER)
    left_out = np.where(np.arange(COVER) < gap[:, None], heads[starts],
                        heads[starts + short]).view(">u8").astype(np.uint64)
    order = np.lexsort((places, docs, *left_out.T[::-1], ranks))
    same = np.zeros(len(order), bool)
    same[1:] = (ranks[order][1:] == ranks[order][:-1]) & (
        left_out[order][1:] == left_out[order][:-1]).all(axis=1)
    return docs[order[same]], places[order[same]]


def _slices(contexts: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Contexts of one anchor, by how far before it the strings start."""
    step = max(1, _BLOCK * 32 // len(contexts))
    for near in range(0, max(c[2] for c in contexts) + 1, step):
        part = []
        for doc, start, place, n, data in contexts:
            first, end = max(0, place - near - step + 1), min(n, place - near + 1)
            if first < end:
                part.append((doc, start + first, place - first, end - first,
                             data[first:end + length - 1]))
        if len(part) > 1:
            yield part


# --- step 1: anchors that occur more than once ---------------------------------------------------

def _repeated_anchors(docs: DataFrame, tasks: int, buckets: int, hot: int, length: int,
                      gram: int) -> DataFrame:
    """Rows with ``doc`` and ``places`` (packed anchors), or with ``hot`` (packed hashes)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            found = list(text_anchors(batch.column(1).to_pylist(), length, gram))
            if not found:
                continue
            hashes, number, at = (np.concatenate([f[k] for f in found]) for k in range(3))
            _, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True,
                                                 return_counts=True)
            # What repeats here is known to repeat; one of its kind is sent on to tell the others.
            known = count[inverse] > 1
            out: list[list] = [[] for _ in range(6)]
            for doc, places in _by_document(keys[number[known]], at[known]):
                _append(out, doc % buckets, doc, places.astype("<u4").tobytes(), b"", b"", b"")
            alone = np.sort(first)
            bucket = (_mixed(hashes[alone]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows = alone[part]
                _append(out, int(bucket[part[0]]), None, at[rows].astype("<u4").tobytes(),
                        hashes[rows].tobytes(), keys[number[rows]].astype("<i8").tobytes(),
                        count[inverse[rows]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                *[pa.array(c, pa.binary()) for c in out[2:]]],
                names=["bucket", "doc", "places", "hashes", "docs", "counts"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            parts, known = [], []
            for doc, places, *packed in rows:
                if doc is not None:
                    known.append((doc, places))
                else:
                    parts.append((np.frombuffer(places, "<u4"), *(
                        np.frombuffer(p, t) for p, t in zip(packed, ("<u8", "<i8", "<u4"),
                                                            strict=True))))
            if known:
                yield _told(*zip(*known, strict=True), [None] * len(known))
            if not parts:
                continue
            at, hashes, docs_of, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
            _, inverse = np.unique(hashes, return_inverse=True)
            total = np.bincount(inverse, counts).astype(np.int64)[inverse]
            # Occurrences that repeat in their own batch have been told there.
            tell_now = (total > 1) & (counts == 1)
            found = list(_by_document(docs_of[tell_now], at[tell_now]))
            if found:
                yield _told([d for d, _ in found],
                            [p.astype("<u4").tobytes() for _, p in found], [None] * len(found))
            many = np.unique(hashes[total > hot])
            if len(many):
                yield _told([None], [None], [many.tobytes()])
    dealt = docs.mapInArrow(deal, "bucket long, doc long, places binary, hashes binary, "
                            "docs binary, counts binary")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        tell, "doc long, places binary, hot binary")


def _append(out, *values) -> None:
    for column, value in zip(out, values, strict=True):
        column.append(value)


def _told(docs: list, places: list, hot: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(places, pa.binary()), pa.array(hot, pa.binary())],
        names=["doc", "places", "hot"])


def _by_document(docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(docs):
        return
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for start, part in zip([0, *cuts], np.split(values, cuts), strict=True):
        yield int(docs[start]), part


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows bucket by bucket (the first column), which come sorted by it."""
    held, now = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, *row in zip(*columns, strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(row)
    if held:
        yield held


# --- step 2: contexts of repeated anchors --------------------------------------------------------

_CONTEXT = ("bucket long, anchor long, doc long, start long, place long, n long, context binary, "
            "other long")


def _contexts(joined: DataFrame, buckets: int, hot: np.ndarray, length: int,
              gram: int) -> DataFrame:
    """Contexts (``context`` set), single strings of hot anchors (``other`` set: the second half of
    the hash, ``anchor`` the first), or runs known to repeat (neither set)."""
    hot_set = set(hot.tolist())

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            single: set[tuple[int, int]] = set()
            # Earlier documents first: they are what stays.
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(
                zero_copy_only=False), kind="stable")))
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            told = np.concatenate([
                np.frombuffer(b"".join(p), "<u4").astype(np.int64) | k << 32
                for k, p in enumerate(batch.column(2).to_pylist())])
            for hashes, number, at, first, count in text_anchors(texts, length, gram):
                use = np.isin(at | number << 32, told)
                hashes, number, at, first, count = (
                    c[use] for c in (hashes, number, at, first, count))
                bucket = (_mixed(hashes) % np.uint64(buckets)).astype(np.int64).tolist()
                out: list[list] = [[] for _ in range(8)]
                for b, h, k, a, lo, n in zip(bucket, hashes.tolist(), number.tolist(),
                                             at.tolist(), first.tolist(), count.tolist(),
                                             strict=True):
                    data, doc = texts[k][lo:lo + n + length - 1], docs[k]
                    if h in hot_set:
                        _give_single(out, single, doc, lo, data, length, buckets)
                    elif data in seen:
                        _append(out, doc % buckets, 0, doc, lo, 0, n, None, None)
                    else:
                        seen.add(data)
                        _append(out, b, h - 2**64 if h >= 2**63 else h, doc, lo, a - lo, n, data,
                                None)
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(c, pa.int64()) for c in out[:6]], pa.array(out[6], pa.binary()),
                    pa.array(out[7], pa.int64())],
                    names=["bucket", "anchor", "doc", "start", "place", "n", "context", "other"])
    return joined.mapInArrow(give, _CONTEXT)


def _give_single(out, single, doc: int, lo: int, data: bytes, length: int, buckets: int) -> None:
    codes = np.frombuffer(data, np.uint8)
    one = gram_hashes(codes, length).view(np.int64).tolist()
    two = gram_hashes(codes, length, _BASE + 2).view(np.int64).tolist()
    for k, key in enumerate(zip(one, two, strict=True)):
        if key in single:
            _append(out, doc % buckets, 0, doc, lo + k, 0, 1, None, None)
        else:
            single.add(key)
            _append(out, key[0] % buckets, key[0], doc, lo + k, 0, 1, None, key[1])


def _sorted_buckets(contexts: DataFrame, tasks: int, length: int) -> DataFrame:
    """Runs of repeated starts: ``doc`` and ``runs`` (packed starts and counts)."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            # Runs as plain numbers, one at a time; arrays of sorted starts beside them.
            told: tuple[list[int], list[int], list[int]] = ([], [], [])
            docs: list[np.ndarray] = []
            runs: list[np.ndarray] = []

            def tell_sorted(found, docs=docs, runs=runs):
                docs.append(found[0])
                runs.append(np.stack([found[1], np.ones(len(found[1]), np.int64)], axis=1))

            def tell(*run, told=told):
                _append(told, *run)
            by_anchor: dict[int, dict[bytes, tuple]] = {}
            single: dict[tuple[int, int], tuple[int, int]] = {}
            for anchor, doc, start, place, n, data, other in rows:
                if data is None and other is None:
                    tell(doc, start, n)
                    continue
                # Of equal ones only the first goes on; the other one is a repeat as a whole.
                known, key, value = (
                    (single, (anchor, other), (doc, start)) if data is None else
                    (by_anchor.setdefault(anchor, {}), data, (doc, start, place, n)))
                before = known.get(key)
                if before is None or value < before:
                    known[key], value = value, before
                if value:
                    tell(value[0], value[1], n)
            block: list[tuple] = []
            for distinct in by_anchor.values():
                if len(distinct) > _BLOCK:
                    for part in _slices([(*v, d) for d, v in distinct.items()], length):
                        tell_sorted(repeated_starts(part, length))
                elif len(distinct) > 1:
                    block.extend((*v, data) for data, v in distinct.items())
                    if len(block) >= _BLOCK:
                        tell_sorted(repeated_starts(block, length))
                        block = []
            if block:
                tell_sorted(repeated_starts(block, length))
            if told[0]:
                docs.append(np.array(told[0], np.int64))
                runs.append(np.array(told[1:], np.int64).T)
            if docs:
                doc, run = np.concatenate(docs), np.concatenate(runs)
                found = list(_by_document(doc, np.arange(len(doc))))
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, _ in found], pa.int64()),
                    pa.array([run[k].astype("<u4").tobytes() for _, k in found], pa.binary())],
                    names=["doc", "runs"])
    return contexts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        judge, "doc long, runs binary")


# --- step 3: what is left of each document -------------------------------------------------------

def _removed(rows: DataFrame, id_type: str, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for k in range(batch.num_rows):
                text, runs = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                edges = np.zeros(len(text) + 1, np.int64)
                for packed in runs or ():
                    pairs = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)
                    np.add.at(edges, pairs[:, 0], 1)
                    np.add.at(edges, pairs.sum(axis=1) - 1 + length, -1)
                gone = np.cumsum(edges)[:-1] > 0
                change = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans.append([{"start": a, "end": b} for a, b in change.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(spans, pa.list_(pa.struct([
                    ("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "removed", "kept"])
    return rows.mapInArrow(
        cut, f"id {id_type}, removed array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int | None = None,
                   hot_contexts: int = HOT_CONTEXTS,
                   task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per document: ``id``, ``removed`` (byte spans) and ``kept`` (the other bytes)."""
    if length <= COVER:
        raise ValueError(f"length must be above {COVER}")
    gram = gram or min(GRAM, length // 4)
    keyed = with_key(docs, id_col, text_col)
    # Keys are never null; said here, both joins below read the documents in the same way.
    keyed = keyed.where("doc is not null").select(
        "doc", F.col("text").cast("binary").alias("text"),
        F.col("id" if "id" in keyed.columns else "doc").alias("id"))
    size = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(1, -(-size // task_bytes),
                int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = tasks * _BUCKETS_PER_TASK
    told = staged(_repeated_anchors(keyed.select("doc", "text"), tasks, buckets, hot_contexts,
                                    length, gram), "anchors")
    hot = [np.frombuffer(row["hot"], "<u8") for row in
           told.where(F.col("hot").isNotNull()).select("hot").collect()]
    hot_list = np.unique(np.concatenate(hot)) if hot else np.empty(0, np.uint64)
    places = told.where(F.col("doc").isNotNull()).groupBy("doc").agg(
        F.collect_list("places").alias("places"))
    # Both joins read the same columns, so the documents are dealt out by key once for both.
    joined = keyed.join(places, "doc").select("doc", "text", "places", "id")
    runs = _sorted_buckets(
        _contexts(joined, buckets, hot_list, length, gram), tasks, length).groupBy("doc").agg(
        F.collect_list("runs").alias("runs"))
    return _removed(keyed.join(runs, "doc", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "text", "runs"),
        docs.schema[id_col].dataType.simpleString(), length)
