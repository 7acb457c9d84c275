"""Best-fit packing, fill-in-middle and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitframe.llm import best_fit, fill_middle, filter_audit, queries
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")


# --- best-fit packing ----------------------------------------------------------------------------

def plain_ids(text):
    from tokenizers import Tokenizer
    plain = plain_ids.__dict__.setdefault("tokenizer", Tokenizer.from_file(WORDS_FILE))
    return [*plain.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(
    ["it's", " ", "\n", "\v", "\x1c", "\x85", "\xa0", "　", "é", "́", "İ", "ΣΑΣ",
     "<|endoftext|>", "<|startoftext|", ">", "12a3", "Word", ",", "-_", "'s", "<|ENDOFTEXT|>",
     "Éà", "ß", "ÿ", "×", "ª", "ı", "...", "漢字", "𝒳", "word", "'ll", "\0"])))
def test_ids_are_those_of_the_tokenizer(parts):
    text = "".join(parts)
    tokens = test_ids_are_those_of_the_tokenizer.__dict__.setdefault(
        "tokens", best_fit.Tokens(WORDS_FILE))
    assert list(memoryview(tokens.of(text)).cast("I")) == plain_ids(text)[:-1]


def test_ids_of_long_texts_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(best_fit, "_AT_ONCE", 50)
    monkeypatch.setattr(best_fit, "_REMEMBERED", 20)
    tokens = best_fit.Tokens(WORDS_FILE)
    for text in (prose(3, 400), "x" * 300 + " " + "y" * 300, " " * 200 + "z" + "\n" * 200, ""):
        assert list(memoryview(tokens.of(text)).cast("I")) == plain_ids(text)[:-1]


def slow_bins(sizes, length, limit):
    """Bins as they close: the same rules by looking through all open bins."""
    opened, closed = [], []
    for k, size in enumerate(sizes):
        fitting = [b for b in opened if length - sum(s for _, s in b) >= size]
        if fitting:
            room = min(length - sum(s for _, s in b) for b in fitting)
            best = next(b for b in fitting if length - sum(s for _, s in b) == room)
        else:
            if len(opened) == limit and size < length:
                room = min(length - sum(s for _, s in b) for b in opened)
                full = next(b for b in opened if length - sum(s for _, s in b) == room)
                opened.remove(full)
                closed.append(full)
            best = []
        if best in opened:
            opened.remove(best)
        best.append((k, size))
        (closed if sum(s for _, s in best) == length else opened).append(best)
    return closed, opened


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60), st.integers(1, 5))
def test_bins_are_those_of_a_plain_search(sizes, limit):
    bins = best_fit.OpenBins(12, limit, 0)
    closed = []
    for k, size in enumerate(sizes):
        closed += [[(item, sizes[item]) for _, item in placed]
                   for _, placed in bins.put(size, k)]
        assert bins.n_open <= limit
    expected_closed, expected_open = slow_bins(sizes, 12, limit)
    assert closed == expected_closed
    assert sorted([(i, sizes[i]) for _, i in placed] for _, placed in bins.rest()) == sorted(
        expected_open)


def check_sequences(rows, texts, length):
    """Every document's ids lie in its pieces, every sequence is gapless."""
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["id"]].append(r)
    for placed in bins.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= length
    got = Counter()
    for found in pieces.values():
        for r in found:
            got[(r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    expected = Counter()
    for doc, text in texts:
        ids = plain_ids(text or "")
        for piece, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            stored = b"".join(i.to_bytes(4, "little") for i in part)
            expected[(doc, piece, at, len(part), zlib.crc32(stored))] += 1
    assert got == expected
    return len(bins)


def test_pack_best_fit(spark):
    rows = odd_rows() + [(100 + k, prose(k, 5 + 13 * k % 90), "en", "s") for k in range(150)]
    docs = documents(spark, rows, extra=True).repartition(5)
    packed = best_fit.pack_best_fit(docs, WORDS_FILE, length=256, open_bins=4, task_tokens=4096,
                                    with_ids=True).collect()
    n = check_sequences(packed, [r[:2] for r in rows], 256)
    by_doc = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        by_doc.setdefault(r["id"], []).extend(r["ids"])
    assert by_doc[5] == plain_ids(rows[7][1])
    total = sum(r["length"] for r in packed)
    # Every task but the last leaves its open bins to the next round.
    assert n <= total / 256 * 1.15 + 4
    assert best_fit.pack_best_fit(spark.createDataFrame([], SCHEMA), WORDS_FILE).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack_best_fit(docs, WORDS_FILE, task_tokens=1000)


def test_op11_on_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    packed = queries.op11_best_fit(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    n = check_sequences(packed, texts, 2048)
    assert n <= -(-sum(r["length"] for r in packed) // 2048) * 1.05 + 1


# --- fill-in-middle ------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fill(doc, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é漢𝒳 \n\t\v\x1c\x85")), st.integers(1, 9))
def test_cuts_are_those_of_a_plain_search(text, block):
    units = fill_middle.Units(text.encode(), block)
    expected = UNIT.findall(text)
    assert units.n == len(expected)
    for k in range(units.n + 1):
        head = "".join(expected[:k])
        assert units.cut(k) == (len(head.encode()), len(head))


def test_fill_middle(spark):
    rows = odd_rows() + [
        (20 + k, t, "en", "s") for k, t in enumerate(
            ["a<P>b", "<S", "x <M> y", "<", ">", "<P", "S> <", "\n", "a\n", "<<", "M>"] * 6)]
    rows += [(200 + k, prose(k, k) + " \n" * (k % 3), "en", "s") for k in range(80)]
    filled = fill_middle.fill_middle(documents(spark, rows, extra=True), block=64)
    got = [tuple(r) for r in filled.select("id", "n", "form", "output", "prefix_chars", "middle_chars",
                                           fill_middle.restored()).collect()]
    expected = [(r[0], *plain_fill(r[0], r[1] or ""), r[1] or "") for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_middle(documents(spark, rows), markers=("<P>", "<<>", "<M>"))


# --- filter audit --------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=5), st.sets(st.integers(0, 40)))
def test_union_sizes(sets, marked):
    lists = [sorted(s) for s in sets]
    marks = [[filter_audit.counts_before(ids, sorted(marked))] for ids in lists]
    union = set().union(*sets)
    assert filter_audit.union_sizes(lists, marks) == [len(union), len(union & marked)]


def plain_audit(rows, labels):
    seen, failed = {}, []
    for doc, text, _ in rows:
        if doc is not None:
            seen[text or ""] = min(seen.get(text or "", doc), doc)
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and doc > seen[text]})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    figures, shapley = {}, Counter()
    parts = {r[2] or "" for r in rows}
    for part in parts:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, name in enumerate(order, 1):
                fails = {k for k in mine if failed[k][name]}
                gone = left & fails
                redundant = fails - left
                left -= fails
                shapley[part, name] += len(gone)
                figures[part, "".join(order), step] = (
                    len(left), len(gone), len(redundant),
                    sum(sum(failed[k].values()) == 1 for k in fails),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone))
    return sorted((*key, *value, shapley[key[0], key[1][key[2] - 1]])
                  for key, value in figures.items())


@pytest.mark.parametrize("unique", [True, False])
def test_filter_audit(spark, unique):
    rows = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(
        ["", "A B", "one # two", prose(1, 150), " ".join("word" for _ in range(120)),
         prose(2, 120) + " |", "É" * 30, prose(1, 150), "A" * 500, None, " \n"] * 8)]
    if not unique:
        rows += [(None, "", "en"), (None, None, "fr"), (3, "A B", "de"), (3, "A B", "de"),
                 (-5, "A B", "xx")]
    labels = [(k, k % 2, (k // 3) % 2) for k in range(0, 70)] + [(3, 1, None), (3, 0, 1), (None, 1, 1)]
    docs = documents(spark, [(*r, "s") for r in rows], extra=True)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, block=7)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant",
                           "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)


def test_posting_lists_are_sorted_and_whole(spark):
    docs = documents(spark, [(k * 10**12, prose(k, 3 + k), "en" if k % 3 else "de", "s")
                             for k in range(200)])
    rows = filter_audit.tested(docs).selectExpr("*", "doc % 2 = 0 AS good", "false AS toxic")
    lists = filter_audit.posting_lists(rows, block=16).collect()
    assert sum(r["n"] for r in lists) == 200 and all(r["n"] <= 16 for r in lists)
    for r in lists:
        for ids in [*r["failing"], r["good"], r["toxic"]]:
            assert ids == sorted(set(ids))
            assert not ids or r["first_doc"] <= ids[0] and ids[-1] <= r["last_doc"]
    short = sorted(i for r in lists for i in r["failing"][0])
    assert short == [k * 10**12 for k in range(97)]


def test_audit_of_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    some = documents(spark, [(1, "x", "en", "s")])
    assert filter_audit.audit(some, labels).count() == 600
