"""Secret scan, packing, WARC packages and HTML rendering against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import time
import zipfile
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remitframe.llm import html_text, packing, queries, secret_scan, warc_zip
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- secrets -------------------------------------------------------------------------------------

PATTERNS = {
    "assign": (re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]"""
                          r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_spans(text):
    return sorted(((kind, m.start(), m.end()) for kind, (pattern, good) in PATTERNS.items()
                   for m in pattern.finditer(text) if good(m)),
                  key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "AKIA", "akia", "=", ":", " ",
     "'", '"', "ABCDEFGH", "0123456789abcdef", "Z", "é", "İ", "ſ", "K", "\n", "a" * 31, "="])))
def test_spans_are_those_of_a_full_search(parts):
    text = "".join(parts)
    found = secret_scan.find_secrets(text, secret_scan._automaton())
    assert [s for s in found if s[0] in secret_scan.BASE_KINDS] == base_spans(text)


def test_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secret_scan.checksum62(body)}"
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    scan = lambda t: secret_scan.find_secrets(t, secret_scan._automaton())
    assert scan(f"x {good} y") == [("github", 2, 42)]
    assert scan(f"npm_{good[4:]}") == [("npm", 0, 40)]
    assert scan(wrong) == [] and scan(good + "Z") == []
    # A base span is not lost to a checked one.
    assert scan(f"token={good}") == [("assign", 0, 46), ("github", 6, 46)]


def test_secrets_of_a_table(spark):
    rows = odd_rows() + [(30, "é Password: 'hunter2hunter2' " + "0a" * 20, "en", "s")]
    got = secret_scan.scan_secrets(documents(spark, rows, extra=True)).withColumn(
        "joined", secret_scan.joined_spans())
    expected = []
    for r in rows:
        spans = base_spans(r[1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((r[0], hashlib.sha256(joined.encode()).hexdigest(), joined))
    found = [tuple(r) for r in got.select("id", "base_sha256", "joined").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert any("assign:2:" in r[2] and "hex:" in r[2] for r in found)
    assert secret_scan.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


# --- packing -------------------------------------------------------------------------------------

def token_ids(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length", [16, 1024])
def test_pieces(spark, length):
    rows = odd_rows() + [(60, "a <|endoftext|> b", "en", "src1"), (61, "x" * 3000, "en", "src2")]
    rows += [(100 + k, prose(k, 5 + k % 70), "en", f"s{k % 5}") for k in range(80)]
    docs = documents(spark, rows, extra=True).repartition(5)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, length=length, sequences_per_window=2,
                          with_ids=True).collect()
    by_sequence, by_text = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == p["length"] > 0
        packed = b"".join(i.to_bytes(4, "little") for i in p["ids"])
        assert zlib.crc32(packed) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_text[(p["id"], p["doc_tokens"])].append((p["start"], p["ids"]))
    # Every id of every row lies in exactly one piece.
    expected = defaultdict(int)
    for r in rows:
        ids = token_ids(r[1])
        expected[(r[0], len(ids))] += len(ids)
    assert {k: sum(len(x[1]) for x in v) for k, v in by_text.items()} == dict(expected)
    one = {r[0]: token_ids(r[1]) for r in rows if [x[0] for x in rows].count(r[0]) == 1}
    for ident, ids in one.items():
        joined = [i for _, part in sorted(by_text[(ident, len(ids))]) for i in part]
        assert joined == ids
    # Sequences are gapless, and full or a power of two.
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
        sizes.append(at)
    assert sum(s != length for s in sizes) <= length.bit_length()


@pytest.mark.parametrize("weights", [None, [1, 1, 1], [5, 1, 3]])
def test_windows_keep_the_proportions(weights):
    totals = [40_000, 20_000, 4_000]
    targets = weights or totals
    schedule = packing.Schedule(totals, targets, 100, 1000)
    owner = {}
    for queue, n in enumerate(totals):
        for at in range(0, n, 37):        # documents of 37 tokens, wherever they are
            for start, size, sequence, offset in schedule.pieces(queue, at, min(37, n - at)):
                for k in range(size):
                    place = sequence * 100 + offset + k
                    assert place not in owner
                    owner[place] = queue
    assert sorted(owner) == list(range(sum(totals)))
    # While no queue has ended, each window holds its share to within a token.
    windows = min(n * sum(targets) // (w * 1000) for n, w in zip(totals, targets, strict=True))
    taken = [0, 0, 0]
    for k in range(windows):
        for place in range(k * 1000, k * 1000 + 1000):
            taken[owner[place]] += 1
        for queue, w in enumerate(targets):
            assert abs(taken[queue] - (k + 1) * 1000 * w / sum(targets)) < 4


def test_packing_of_nothing(spark):
    assert queries.packed(spark.createDataFrame([], SCHEMA)).count() == 0


# --- WARC packages -------------------------------------------------------------------------------

PAGE_SCHEMA = "page_id long, url string, html string, key string, first string"


def test_round_trip(spark, tmp_path):
    rows = [(k, f"http://e.com/{k}", f"<p>{k % 4}</p>" + "x" * (k % 4)) for k in range(20)]
    rows += [(30, None, None), (31, "http://e.com/\r\nX: y", ""), (None, "u", "<p>0</p>"),
             (None, "u", "alone"), (3, "http://again", "<p>3</p>xxx"), (40, "u", "é漢" * 5000)]
    pages = spark.createDataFrame([(*r, "k", "f") for r in rows], PAGE_SCHEMA).repartition(3)
    got = warc_zip.round_trip(pages, f"{tmp_path}/packages")
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, url, html in rows:
        data = (html or "").encode()
        low = first.get(html or "")
        again = low is not None and i != low
        url = {None: "about:blank", "http://e.com/\r\nX: y": "http://e.com/%0D%0AX: y"}.get(url, url)
        expected.append((i, url, "revisit" if again else "response", low if again else None,
                         base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data),
                         None if again else data))
    found = [(*r[:6], None if r[6] is None else bytes(r[6])) for r in got.select(
        "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes",
        "payload").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    # Other readers find the same: a ZIP library, and gzip over the whole member.
    records = 0
    for path in tmp_path.joinpath("packages").glob("*.wacz"):
        with zipfile.ZipFile(path) as package:
            assert package.testzip() is None
            assert {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}
            records += gzip.decompress(package.read(warc_zip.DATA)).count(b"WARC/1.1\r\n")
    assert records == len(rows)


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"),
                                   (4, "u", "abcd")], "page_id int, url string, html string")
    got = warc_zip.round_trip(pages, f"{tmp_path}/packages", min_payload=3)
    assert {(r["page_id"], r["record_type"]) for r in got.collect()} == {
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_zip64_directory():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as package:
        for k in range(70_000):       # more members than a plain directory counts
            package.writestr(zipfile.ZipInfo(f"m{k}"), b"%d" % k)
        package.comment = b"PK\5\6 in a comment"
    members = warc_zip.stored_members(data)
    start, size = members["m69999"]
    assert len(members) == 70_000 and data.getvalue()[start:start + size] == b"69999"


def test_zip64_sizes_and_packed_members():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as package:
        with package.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as member:
            member.write(b"stored")
        package.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    members = warc_zip.stored_members(data)
    start, size = members["big"]
    assert data.getvalue()[start:start + size] == b"stored" and "packed" not in members
    # The ZIP64 fields stand for the full 32-bit ones only.
    extra = b"\1\0\x10\0" + (5).to_bytes(8, "little") + (7).to_bytes(8, "little")
    full = 0xFFFFFFFF
    assert warc_zip._zip64(extra, full, full, 9) == (7, 5, 9)
    assert warc_zip._zip64(extra, 3, full, full) == (3, 5, 7)
    with pytest.raises(ValueError):
        warc_zip.read_directory(io.BytesIO(b"no package"))


def test_pages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.round_trip(empty, f"{tmp_path}/packages").count() == 0


# --- HTML ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<title>no</title><style>p{}</style><script>if (a < b) '</p>'</script><p>yes", "yes"),
    ("a<span hidden>b</span><i style='DISPLAY : none'>c</i>d", "ad"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol><li>e</ul>",
     "- a\n- b\n  9. c\n  10. d\n- e"),
    ("x<br>y<br><br>z", "x\ny\n\nz"), ("<pre>\n a\n\n  b </pre>c", " a\n\n  b\n\nc"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>end",
     "k        | value\nlong key | v\n\nend"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>",
     "a | b\n  | c\nwide"),
    ("<table><td>no row<td>漢字</table>", "no row | 漢字"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>u</details>",
     "s\nt\nu"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"), ("<b>a</b> <i> b</i>\n c", "a b c"),
    ("<img alt='pic'><input type=hidden value=h><input value=v>", "picv"),
    ("</p></div><td>stray</table>", "stray"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<table><caption>cap<tr><td><table><tr><td>in<td>ner</table><td>out</table>",
     "cap\nin | ner | out"),
    ("<head><meta charset=utf-8><p>body", "body"), ("a<!-- c -->b", "ab"),
])
def test_layout(page, text):
    assert html_text.render(page) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<ol>", "<table>", "<tr>", "<td>",
     "</td>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<dl>", "<dt>", "<dd>", "<br>",
     "<caption>", "<blockquote>", "</blockquote>", "<th rowspan=3>", "<td colspan=2>", "</li>",
     "<section>", "<head>", "</head>", "<body>", " "]), max_size=40))
def test_no_visible_word_is_lost(tags):
    # Words of text that is shown come out, each once, whatever the tags are.
    page = "".join(f"{tag}w{k}x " for k, tag in enumerate(tags))
    found = re.findall(r"w\d+x", html_text.render(page))
    assert sorted(found) == sorted(f"w{k}x" for k in range(len(tags)))


@pytest.mark.parametrize("page,text", [
    ("a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g><text>b<tspan x=1>c</tspan>"
     "</text></g><path/>stray</svg>d", "a b c d"),
    ("<svg><text visibility=hidden>a<tspan visibility=visible>b</tspan></text><text display=none>c"
     "</text><foreignObject><p>e</p></foreignObject></svg>", "b\n\ne"),
    ("<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow>"
     "<annotation>no</annotation></semantics></math>", "x= 1 2"),
    ("<svg><text><![CDATA[a < b]]></text></svg>", "a < b"),
])
def test_drawings_and_formulas(page, text):
    assert html_text.render(page) == text


def test_cells_keep_their_bars():
    assert html_text.render("<table><tr><td>a<td>|<tr><td>b<td>c |<tr><td>d<td></table>") == (
        "a | |\nb | c |\nd")


def test_deep_pages():
    assert html_text.render("<div>" * 50_000 + "deep") == "deep"


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (None, "x")],
                                  "page_id long, html string").withColumn("id", F.lit("e"))
    got = {r["id"]: (r["text"], r["n_chars"], r["n_lines"])
           for r in html_text.extract_text(pages).collect()}
    assert got == {1: ("a\n\nb", 4, 2), 2: ("", 0, 0), None: ("x", 1, 1)}


@pytest.mark.parametrize("page, text", [
    ("seen" + "<a " * 20_000, "seen"), ("seen<b></i>" * 20_000, "seen" * 20_000),
    ("seen <!-- a <b>c</b>" * 2_000, "seen"), ("seen</x " * 20_000, "seen"),
    ("seen <? a", "seen"), ("a < b <3 c", "a < b <3 c"), ("<p>one<p>two</p></p>", "one\n\ntwo"),
])
def test_unfinished_markup_is_neither_slow_nor_shown(page, text):
    began = time.process_time()
    assert html_text.render(page) == text
    assert time.process_time() - began < 3
