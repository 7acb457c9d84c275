"""Secret scan: keyword prefilter, anchored patterns near the hits, checksums inside the match.

One Aho-Corasick automaton finds all keywords of a text in a single pass. Only where a keyword
starts is the pattern of its kind tried, anchored at that place and never inside an earlier match of
the same kind, which finds the same leftmost non-overlapping matches as a search of the whole text.
Hexadecimal keys have no keyword; their scan is anchored at the starts of runs. Tokens that carry a
checksum (the last six characters are the CRC-32 of the rest, in base 62) are only reported if it is
right.

Kinds, in this order: ``assign`` (a name such as ``api_key``, a sign and a value of at least 8
characters), ``access`` (``AKIA`` key ids of at least 16), ``hex`` (runs of at least 32), ``github``
(``ghp_``, ``gho_``, ``ghu_``, ``ghs_``, ``ghr_``) and ``npm`` (``npm_``), the last two with checksum.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table
gives an empty result; a row's other columns are not read. Texts are scanned whole, one row at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import send_by_value, text_of

send_by_value(__name__)

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
CHECKED_BODY = 30          # characters between the prefix and the checksum
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Keywords in lower case, and the kind to try where one starts.
_KEYWORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"),
                             "assign"), "akia": "access",
             **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm"}
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def checksum62(body: str) -> str:
    """CRC-32 of the text in six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _automaton():
    import ahocorasick
    words = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def _lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def find_secrets(text: str, automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in order of start, then kind."""
    spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    done = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in automaton.iter(_lowered(text)):
        start = last - length + 1
        if start < done[kind]:
            continue
        if kind == "assign":
            match = _ASSIGN.match(text, start)
            good = match and len(match[2]) >= MIN_VALUE
        elif kind == "access":
            match = _ACCESS.match(text, start)
            good = match and match.end() - start >= MIN_ACCESS
        else:
            match = _CHECKED.match(text, start)
            good = match and checksum62(match[0][4:-6]) == match[0][-6:]
        if match:
            done[kind] = match.end()
            if good:
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, counts, ``base_sha256`` and ``spans``.

    ``n_assign``, ``n_access`` and ``n_hex`` count base spans, ``n_checked`` the others.
    ``base_sha256`` is the SHA-256 of the base spans written as kind:start:end with commas,
    ``spans`` is an array of structs. Places count code points, ends are exclusive.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            counts = {kind: [] for kind in KINDS}
            digests, found = [], []
            for text in batch.column(1):
                spans = find_secrets(text.as_py(), automaton)
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in spans))
                base = _joined(s for s in spans if s[0] in BASE_KINDS)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS],
                pa.array([a + b for a, b in zip(counts["github"], counts["npm"], strict=True)],
                         pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                    ("end", pa.int64())])))],
                names=["id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256",
                       "spans"])
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        scan, f"id {id_type}, n_assign long, n_access long, n_hex long, n_checked long, "
              "base_sha256 string, spans array<struct<kind: string, start: long, end: long>>")


def joined_spans(spans: str = "spans"):
    """The spans of a row as one text, kind:start:end with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")
