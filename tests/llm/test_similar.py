"""Near duplicates, repeated byte strings and the pipeline against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from remitframe.llm import near_dup, suffix_dedup
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def changed(text: str, seed: int, edits: int) -> str:
    words, pick = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    rows = odd_rows()
    base = prose(77, 120)
    rows += [(200 + k, changed(base, k, 1 + k % 4), "en", "s") for k in range(40)]
    rows += [(300 + k, changed(prose(88, 60), k, k % 3), "en", "s") for k in range(12)]
    rows += [(400 + k, prose(1000 + k, 50), "fr", "s") for k in range(30)]
    return rows + [(500, "a b c d", "en", "s"), (501, "a b\tc d", "en", "s")]


def shingle_set(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def near_classes(rows, threshold=0.8):
    """Rows in order of id (null last), then text: class, class of copies and links of each."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingle_set(r[1]) for r in rows]
    copy_of, known = [], {}
    for k, s in enumerate(sets):
        copy_of.append(k if s is None else known.setdefault(s, k))
    firsts = sorted(set(known.values()))
    root, links = list(range(len(rows))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for n, i in enumerate(firsts):
        for j in firsts[:n]:
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((rows[k][0], rows[find(c)][0], rows[c][0], links[c], find(c) == k)
                   for k, c in enumerate(copy_of)), key=repr)


@pytest.mark.parametrize("blocks", [(512, 2_000_000), (7, 2_000_000), (512, 500)])
def test_near(spark, blocks):
    rows = near_rows()
    got = near_dup.near_duplicates(documents(spark, rows, extra=True), block_texts=blocks[0],
                                   block_shingles=blocks[1])
    found = [tuple(r) for r in got.select(
        "id", "class_id", "copy_of", "n_links", "stays").collect()]
    assert sorted(found, key=repr) == near_classes(rows)


def test_depth_is_shortened_until_the_recall_is_met():
    assert near_dup.prefix_depth(0.8, 0.9999, 24, 8) == 5
    assert near_dup.prefix_depth(0.8, 0.5, 24, 8) == 8
    assert near_dup.prefix_depth(0.3, 0.9999999, 2, 8) == 1


def test_components(spark):
    pick = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)]
    edges += [(pick.randrange(200, 400), pick.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = near_dup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {
        k: find(k) for k in root if find(k) != k}


def test_near_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


# --- repeated byte strings -----------------------------------------------------------------------

def without_repeats(rows, length):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for r in rows:
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            part = data[k:k + length]
            if part in seen:
                gone[k:k + length] = True
            seen.add(part)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
        out.append((r[0], [tuple(s) for s in spans], kept))
    return sorted(out, key=repr)


def byte_rows():
    passage = prose(5, 40)
    rows = odd_rows() + [(60, "a" * 700, "en", "s"), (61, "ab" * 300, "en", "s"),
                         (62, "b" + "a" * 150, "en", "s"), (63, "é" * 80, "en", "s")]
    for k in range(40):
        start = random.Random(k).randrange(0, 60)
        rows.append((100 + k, f"{prose(500 + k, 5)} {passage[start:start + 180]} "
                              f"{prose(600 + k, 5)}", "en", "s"))
    rows += [(200 + k, passage[k:k + 100 + k], "en", "s") for k in range(12)]
    return rows


@pytest.mark.parametrize("hot,block", [(10**6, 10_000), (3, 10_000), (10**6, 4)])
def test_repeats(spark, hot, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    rows = byte_rows()
    got = suffix_dedup.remove_repeats(documents(spark, rows, extra=True), hot_contexts=hot)
    found = sorted(((r["id"], [tuple(s) for s in r["removed"]], bytes(r["kept"]))
                    for r in got.collect()), key=repr)
    assert found == without_repeats(rows, 100)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 256)
    texts = [prose(k, 200).encode() for k in range(3)] + [b"", b"short", b"z" * 900]
    for length, gram in ((100, 24), (150, 37)):
        starts = defaultdict(set)
        for _, number, at, first, count in suffix_dedup.text_anchors(texts, length, gram):
            for k, a, lo, n in zip(number, at, first, count, strict=True):
                for s in range(lo, lo + n):
                    assert s <= a <= s + length - gram and s not in starts[k]
                    starts[k].add(s)
        for k, text in enumerate(texts):
            assert starts[k] == set(range(max(0, len(text) - length + 1)))


def test_cover_has_every_difference():
    for size in (8, 32, 57):
        cover = suffix_dedup.difference_cover(size)
        assert {(a - b) % size for a in cover for b in cover} == set(range(size))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 24, 64, 100, 300])
def test_gram_hashes_tell_strings_apart(size):
    data = np.random.default_rng(1).integers(0, 2, 2000).astype(np.uint8)
    hashes = suffix_dedup.gram_hashes(data, size)
    strings = [bytes(data[k:k + size]) for k in range(len(data) - size + 1)]
    assert len(hashes) == len(strings)
    assert len(set(zip(strings, hashes.tolist(), strict=True))) == len(set(strings)) == len(
        set(hashes.tolist()))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------

def run_stages(spark, docs):
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, docs, "").collect())
        docs = spark.createDataFrame(kept[-1], SCHEMA)
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def pipeline_rows():
    clean = [(k, "\n".join([" ".join(f"the {w} of and" for w in prose(k, 12).split()), "Site menu",
                            " ".join(f"the {w} to in" for w in prose(k + 900, 12).split())]),
              "en", f"src{k % 3}") for k in range(60)]
    copies = [(1000 + k, clean[k][1].replace("menu", "menu"), "en", clean[k][3]) for k in range(8)]
    near = [(2000 + k, changed(clean[k][1], k, 1), "en", clean[k][3]) for k in range(10, 16)]
    junk = [(3000 + k, " ".join(w.upper() + "!!##" for w in prose(k, 60).split()), "en", "src1")
            for k in range(4)] + [(3100, "too short", "en", "src2"), (3101, None, None, None)]
    return clean, copies, near, junk


def test_stages(spark):
    clean, copies, near, junk = pipeline_rows()
    (good, lines, distinct, mixed), pieces = run_stages(
        spark, documents(spark, clean + copies + near + junk))
    assert {r["doc_id"] for r in good} == {r[0] for r in clean + copies + near}
    texts = {r["doc_id"]: r["text"] for r in lines}
    assert len(lines) == len(good) and not any("Site menu" in t for t in texts.values())
    assert all(texts[r[0]] == r[1].replace("\nSite menu", "") for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    expected = {r[0] for r in near_classes([(i, t) for i, t in texts.items()]) if r[4]}
    assert {r["doc_id"] for r in distinct} == expected
    assert {r[0] for r in clean} <= expected and not expected & {r[0] for r in copies}
    taken = {r["doc_id"]: r["text"] for r in mixed}
    assert set(taken) <= expected
    size = lambda ids: sum(-(-len(texts[i].encode()) // 4) for i in ids)
    assert 0.7 * size(expected) < size(taken) <= 0.9 * size(expected)
    assert {p["doc_id"] for p in pieces} == set(taken)
    whole = Counter()
    for p in pieces:
        whole[p["doc_id"]] += p["length"]
    assert all(whole[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_stages_with_odd_rows(spark, monkeypatch):
    found = []
    for limit in (corpus_pipeline.BROADCAST_DROPPED, 0):   # by broadcast and by shuffle
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_DROPPED", limit)
        kept, pieces = run_stages(spark, documents(spark, odd_rows()))
        assert {p["doc_id"] for p in pieces} <= {r[0] for r in odd_rows()}
        found.append([sorted(map(repr, k)) for k in kept])
    assert found[0] == found[1]
    # The rules leave texts of 20 words and more that do not repeat themselves.
    good = [r for r in odd_rows() if len((r[1] or "").split()) >= 20 and r[0] != -9]
    assert len(found[0][0]) == len(good)


def test_stages_of_nothing(spark):
    kept, pieces = run_stages(spark, spark.createDataFrame([], SCHEMA))
    assert not any(kept) and not pieces
