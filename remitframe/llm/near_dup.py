"""Near duplicates by n-gram Jaccard similarity: MinHash banding with exact verification.

A text's set holds the hashes of its runs of ``NGRAM`` words (one run of all words if it has fewer).
Texts with equal sets are copies and form a class that is represented once. In each of
``trees`` bands of MinHash values, called trees here, representatives with equal values meet and are
candidates. A band has the most values, up to ``max_depth``, with which a pair at the threshold meets
in some tree with the target recall; this is settled before any row is read, and there are no prefix
tries as in an LSH forest, the method that was asked for. With that depth every more similar
pair meets with a higher chance. Candidates are verified on their whole sets.

No pair is ever a row. A group that meets in a tree is verified in one task as a matrix product;
trees in which the same group meets do it once, and a pair is counted in the first tree in which it
meets. A large group is divided into blocks, and each two blocks are verified in a task of their
own. What leaves a task is a number of links per text and a tree of edges per connected part.
Classes are the connected components, found by alternating star contractions in Spark.

Defined results: null and empty texts, or ones of white space only, are alone; rows with a null id come
after all others and have a null class id only if the whole class has; repeated rows are copies of
each other; an empty table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import send_by_value, staged, with_key
from remitframe.session import checkpointed

send_by_value(__name__)

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES = 24
MAX_DEPTH = 8
# A task compares blocks of so many texts, or so many shingles.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 2_000_000
# Words of the vocabulary that one matrix product covers.
_COLUMNS = 4096
_MULTIPLY = 0x9E3779B97F4A7C15


def prefix_depth(threshold: float, recall: float, trees: int, max_depth: int) -> int:
    """Shortens the prefix from ``max_depth`` until a pair at the threshold is met often enough."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: bytes, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; words end at blanks and U+0009 to U+000D."""
    import xxhash
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    code = xxhash.xxh64_intdigest
    hashes = np.array([code(w) for w in words], np.uint64)
    runs = max(1, len(hashes) - ngram + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(min(ngram, len(hashes))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_MULTIPLY) + hashes[k:k + runs]
    return np.unique(out ^ (out >> np.uint64(32)))


def _signature_seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    return (random.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1),
            random.integers(0, 2**64, count, dtype=np.uint64))


def signature(items: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the items."""
    least = np.full(len(multiply), 2**64 - 1, np.uint64)
    for start in range(0, len(items), 512):
        part = items[start:start + 512, None] * multiply + add
        least = np.minimum(least, part.min(axis=0))
    return least


def tree_labels(values: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One hash per tree of the prefix of its values."""
    values = values.reshape(trees, -1)
    label = np.arange(1, trees + 1, dtype=np.uint64)
    for k in range(depth):
        label = (label ^ (label >> np.uint64(31))) * np.uint64(_MULTIPLY) + values[:, k]
    return (label ^ (label >> np.uint64(32))).view(np.int64)


def _signed(keyed: DataFrame, ngram: int, trees: int, depth: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        multiply, add = _signature_seeds(trees * depth)
        for batch in batches:
            digests, sizes, labels = [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), ngram)
                sizes.append(len(items))
                if len(items):
                    digests.append(xxhash.xxh128_digest(items.tobytes()))
                    labels.append(tree_labels(signature(items, multiply, add), trees, depth))
                else:
                    digests.append(None)
                    labels.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(labels, pa.list_(pa.int64()))],
                names=["doc", "digest", "size", "labels"])
    return keyed.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(
        sign, "doc long, digest binary, size long, labels array<long>")


def _meetings(representatives: DataFrame, block_texts: int, block_shingles: int) -> DataFrame:
    """Where each text is verified: ``doc``, ``tree``, ``label`` and the number of ``blocks``."""
    met = representatives.select("doc", "size", F.posexplode("labels").alias("tree", "label"))
    groups = met.groupBy("tree", "label").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("size").alias("shingles"),
        F.min("doc").alias("first"), F.bit_xor(F.xxhash64("doc")).alias("members"),
        F.sum(F.xxhash64("doc").bitwiseAND(F.lit((1 << 40) - 1))).alias("check"))
    # The same group meeting in several trees is verified in the first of them.
    once = groups.where("texts > 1").groupBy("texts", "first", "members", "check", "shingles").agg(
        F.min(F.struct("tree", "label")).alias("at"))
    units = once.select("at.tree", "at.label", F.ceil(F.greatest(
        F.col("texts") / block_texts, F.col("shingles") / block_shingles)).cast("int").alias(
            "blocks"))
    return met.select("doc", "tree", "label").join(units, ["tree", "label"])


_UNIT = "unit binary, doc long, side int, tree int, labels binary, items binary"


def _sent(joined: DataFrame, ngram: int) -> DataFrame:
    """A row for each task that verifies the text, with its whole set."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for k in range(batch.num_rows):
                doc, text, labels, meetings = (batch.column(c)[k].as_py() for c in range(4))
                items = shingles(text, ngram).tobytes()
                packed = np.array(labels, "<i8").tobytes()
                for meeting in meetings:
                    tree, label, blocks = (meeting[c] for c in ("tree", "label", "blocks"))
                    own = (doc * 2654435761 >> 7) % blocks
                    for other in range(blocks):
                        low, high = min(own, other), max(own, other)
                        unit = np.array([tree, label, low, high], "<i8").tobytes()
                        for column, value in zip(out, (
                                unit, doc, int(own == high), tree, packed, items), strict=True):
                            column.append(value)
                        held += len(items)
                        if held > 16 << 20:
                            yield _sent_batch(out)
                            out, held = [[] for _ in range(6)], 0
            yield _sent_batch(out)
    return joined.mapInArrow(send, _UNIT)


def _sent_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
        names=["unit", "doc", "side", "tree", "labels", "items"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    sizes = [len(s) for s in (*left, *right)]
    _, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True,
                                 return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = count[column] > 1       # the others are in no intersection
    new = np.cumsum(count > 1) - 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = int((count > 1).sum())
    for start in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, (start, start + _COLUMNS))
        part = np.zeros((len(sizes), min(_COLUMNS, width - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        total += part[:len(left)] @ part[len(left):].T
    return total


def verified_links(docs: np.ndarray, sides: np.ndarray, tree: int, labels: np.ndarray,
                   sets: list[np.ndarray], threshold: float, within: bool):
    """Links between two blocks (or within one): texts, number of links, and edges to a root."""
    one = np.flatnonzero(sides == 0) if not within else np.arange(len(docs))
    two = np.flatnonzero(sides == 1) if not within else one
    if not len(one) or not len(two):
        return docs[:0], docs[:0], docs[:0]
    size = np.array([len(s) for s in sets], np.float64)
    shared = intersections([sets[k] for k in one], [sets[k] for k in two])
    linked = shared / (size[one][:, None] + size[two][None, :] - shared) >= threshold
    for earlier in range(tree):
        linked &= labels[one, earlier][:, None] != labels[two, earlier][None, :]
    if within:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(docs), np.int64)
    np.add.at(links, one, linked.sum(axis=1))
    if not within:
        np.add.at(links, two, linked.sum(axis=0))
    # The smallest text that each can reach.
    order = np.argsort(docs, kind="stable")
    root = np.empty(len(docs), np.int64)
    root[order] = np.arange(len(docs))
    while True:
        before = root.copy()
        far = np.where(linked, root[two][None, :], len(docs)).min(axis=1)
        root[one] = np.minimum(root[one], far)
        far = np.where(linked, root[one][:, None], len(docs)).min(axis=0)
        root[two] = np.minimum(root[two], far)
        if (root == before).all():
            break
    has = links > 0
    return docs[has], links[has], docs[order][root[has]]


def _verified(sent: DataFrame, threshold: float) -> DataFrame:
    """``doc``, ``links`` found in a task, and ``root``, a text of the same component."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _units(batches):
            docs, sides, trees, labels, items = zip(*rows, strict=True)
            _, _, low, high = np.frombuffer(unit, "<i8").tolist()
            found = verified_links(
                np.array(docs, np.int64), np.array(sides), trees[0],
                np.stack([np.frombuffer(x, "<i8") for x in labels]),
                [np.frombuffer(x, "<u8") for x in items], threshold, low == high)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found],
                                                 names=["doc", "links", "root"])
    return sent.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        verify, "doc long, links long, root long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[tuple]]]:
    held, now = [], None
    for batch in batches:
        for unit, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unit != now and held:
                yield now, held
                held = []
            now = unit
            held.append(row)
    if held:
        yield now, held


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (``a``, ``b``): ``node`` and the smallest node, ``root``.

    Alternates large-star and small-star contractions; every round is checkpointed.
    """
    edges = checkpointed(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # All edges now go from larger to smaller; small-star looks at the smaller ones only.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        edges = checkpointed(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(
            "a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
                    max_depth: int = MAX_DEPTH, ngram: int = NGRAM,
                    block_texts: int = BLOCK_TEXTS,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document.

    ``id``; ``class_id``, the smallest id among the documents connected by links and copies;
    ``copy_of``, the id that represents texts with an equal set; ``n_links``, the number of other
    representatives at least ``threshold`` similar; ``stays``, true for one document of a class.
    """
    keyed = with_key(docs, id_col, text_col)
    depth = prefix_depth(threshold, recall, trees, max_depth)
    signed = staged(_signed(keyed, ngram, trees, depth), "signatures")
    classes = staged(signed.where("size > 0").groupBy("digest").agg(
        F.min("doc").alias("class")), "classes")
    copies = staged(signed.select("doc", "digest").join(classes, "digest", "left").select(
        "doc", F.coalesce("class", "doc").alias("class")), "copies")
    representatives = signed.where("size > 0").join(
        classes, F.col("doc") == F.col("class"), "left_semi")
    meetings = _meetings(representatives, block_texts, block_shingles).groupBy("doc").agg(
        F.collect_list(F.struct("tree", "label", "blocks")).alias("meetings"))
    joined = keyed.select("doc", F.col("text").cast("binary").alias("text")).join(
        representatives.select("doc", "labels").join(meetings, "doc"), "doc").select(
        "doc", "text", "labels", "meetings")
    links = staged(_verified(_sent(joined, ngram), threshold), "links")
    roots = components(links.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    per_text = links.groupBy(F.col("doc").alias("class")).agg(F.sum("links").alias("n_links"))
    whole = copies.join(per_text, "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left").select(
        "doc", "class", F.coalesce("root", "class").alias("root"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return _with_ids(whole, keyed)


def _with_ids(whole: DataFrame, keyed: DataFrame) -> DataFrame:
    """Keys back to ids. They are the same unless ids repeat or are null."""
    stays = F.col("doc") == F.col("root")
    if "id" not in keyed.columns:
        return whole.select(F.col("doc").alias("id"), F.col("root").alias("class_id"),
                            F.col("class").alias("copy_of"), "n_links", stays.alias("stays"),
                            F.col("doc").alias("key"))
    ids = keyed.select("doc", "id")
    root = ids.select(F.col("doc").alias("root"), F.col("id").alias("class_id"))
    first = ids.select(F.col("doc").alias("class"), F.col("id").alias("copy_of"))
    return whole.join(ids, "doc").join(root, "root").join(first, "class").select(
        "id", "class_id", "copy_of", "n_links", stays.alias("stays"), F.col("doc").alias("key"))
