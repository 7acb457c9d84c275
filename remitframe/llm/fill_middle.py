"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in another order.

A unit is a word with the white space before it; white space at the end is one more. Two hashes of
the document's id choose the units where the middle starts and ends, two more the form: ``plain``
(unchanged), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its
marker.

A text is divided into fixed blocks of ``block`` bytes of UTF-8. A Fenwick tree over the blocks holds
how many units end and how many code points start in each. The cut after k units is found by
descending it in steps of falling powers of two (binary lifting) to the block in which the k-th unit ends,
and then within that block alone; the code points before the cut come from the same descent. Any
number of cuts of a text share one tree, and only blocks that hold a cut are looked into.

Nothing is shuffled; a text with its counts is all that a task holds beside its batch.

Defined results: a null text is empty; an empty text and one that holds a marker stay plain, with
``prefix_chars`` and ``middle_chars`` null. The hash of a null id is that of no digits at all. Equal ids
get equal hashes. Repeated rows give repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import send_by_value, text_of

send_by_value(__name__)

SEED = 42
CHANGED_PERCENT = 50
SPM_PERCENT = 80
# Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 1024
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Fenwick:
    """Prefix sums of units and code points over blocks, with search by units."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.n = len(units)
        places = np.arange(1, self.n + 1)
        below = places - (places & -places)
        self.units, self.points = (
            [0, *(sums[places] - sums[below]).tolist()]
            for sums in (np.concatenate(([0], np.cumsum(x))) for x in (units, points)))

    def find(self, k: int) -> tuple[int, int, int]:
        """The block in which unit k ends, k less the units before it, the code points before."""
        block, points = 0, 0
        step = 1 << (self.n.bit_length() - 1)
        while step:
            onward = block + step
            if onward <= self.n and self.units[onward] < k:
                block, k, points = onward, k - self.units[onward], points + self.points[onward]
            step >>= 1
        return block, k, points


class Units:
    """The units of a text in UTF-8."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        data = np.frombuffer(text, np.uint8)
        blank = _IS_BLANK[data]
        self.ends = ~blank
        self.ends[:-1] &= blank[1:]
        if len(data) and blank[-1]:
            self.ends[-1] = True
        self.starts = (data & 0xC0) != 0x80
        firsts = np.arange(0, len(data), block)
        self.n = int(self.ends.sum())
        self.tree = Fenwick(np.add.reduceat(self.ends, firsts, dtype=np.int64),
                            np.add.reduceat(self.starts, firsts, dtype=np.int64)) if self.n else None

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units."""
        if not k:
            return 0, 0
        block, k, points = self.tree.find(k)
        first = block * self.block
        inside = int(np.flatnonzero(self.ends[first:first + self.block])[k - 1]) + 1
        return first + inside, points + int(self.starts[first:first + inside].sum())


def cut_text(text: bytes, form: str, first: int, second: int, markers: tuple[bytes, ...],
             block: int) -> tuple:
    """Units, form, output and the code points of prefix and middle of one text."""
    units = Units(text, block)
    if form == "plain" or not text or any(m in text for m in markers):
        return units.n, "plain", text, None, None
    a, b = sorted((first % (units.n + 1), second % (units.n + 1)))
    (prefix_end, prefix), (middle_end, both) = units.cut(a), units.cut(b)
    parts = text[:prefix_end], text[middle_end:], text[prefix_end:middle_end]
    p, s, m = (marker + part for marker, part in zip(markers, parts, strict=True))
    return units.n, form, p + s + m if form == "psm" else s + p + m, prefix, both - prefix


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                changed_percent: int = CHANGED_PERCENT, spm_percent: int = SPM_PERCENT,
                markers: tuple[str, str, str] = MARKERS, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id``, ``n``, ``form``, ``output``, ``prefix_chars``, ``middle_chars``.

    The first character of each marker must not occur further on in any of them.
    """
    if any(a[0] in b[1:] for a in markers for b in markers):
        raise ValueError("markers could arise where parts meet")
    id_type = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"),
                                                           F.lit(""))), 256)

    def number(k: int) -> Column:
        return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    form = F.when(number(2) % 100 >= changed_percent, "plain").when(
        number(3) % 100 < spm_percent, "spm").otherwise("psm")
    stored = tuple(m.encode() for m in markers)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_text(text.as_buffer().to_pybytes(), form.as_py(), first.as_py(),
                             second.as_py(), stored, block)
                    for text, form, first, second in zip(*batch.columns[1:], strict=True)]
            n, forms, outputs, prefixes, middles = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(prefixes, pa.int64()),
                pa.array(middles, pa.int64())],
                names=["id", "n", "form", "output", "prefix_chars", "middle_chars"])
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"),
                       digest.alias("digest")).select(
        "id", "text", form.alias("form"), number(0).alias("first"),
        number(1).alias("second")).mapInArrow(
        cut, f"id {id_type}, n long, form string, output string, prefix_chars long, "
             "middle_chars long")


def restored(form: str = "form", output: str = "output",
             markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of.

    No part holds a marker and none can arise where parts meet, so splitting at the markers gives
    the parts back.
    """
    found = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), 4)
    prefix_first = F.concat(found[1], found[3], found[2])
    return F.when(F.col(form) == "plain", F.col(output)).when(
        F.col(form) == "psm", prefix_first).otherwise(F.concat(found[2], found[3], found[1]))
