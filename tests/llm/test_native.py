"""Line dedup, quality rules, exact dedup and mixing against plain loops."""

from __future__ import annotations

import hashlib
import math
import os
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from remitframe.llm import exact_dedup, line_dedup, mixing, quality
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# --- line dedup ----------------------------------------------------------------------------------

def cleaned_lines(rows, ratio, min_pages):
    lines = [(text or "").split("\n") for _, text, _, _ in rows]
    trim = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d")
    pages, often = Counter(r[3] for r in rows), Counter()
    for r, ls in zip(rows, lines, strict=True):
        often.update({(r[3], trim(x)) for x in ls if trim(x)})
    bad = {k for k, n in often.items() if n >= min_pages and n > ratio * pages[k[0]]}
    out = []
    for r, ls in zip(rows, lines, strict=True):
        left = [x for x in ls if (r[3], trim(x)) not in bad]
        dropped = len(ls) - len(left)
        out.append((r[0], "\n".join(left) if dropped else r[1],
                    sum(bool(trim(x)) for x in ls), dropped))
    return sorted(out, key=repr)


def line_rows():
    rows = [(k, f"{prose(k, 8)}\n  Menu Home \n{prose(100 + k, 5)}\n\nFooter", "en",
             "a" if k % 3 else "b") for k in range(30)]
    return rows + [(90, "Footer", "en", "c"), (91, "Menu Home", None, None)] + odd_rows()


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_lines(spark, broadcast_rows):
    rows = line_rows()
    got = line_dedup.drop_boilerplate(documents(spark, rows, extra=True), ratio=0.5,
                                      broadcast_rows=broadcast_rows)
    found = [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(found, key=repr) == cleaned_lines(rows, 0.5, 3)
    assert got.columns.count("n_lines") == 1 and "host" in got.columns


def test_lines_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_a_line_on_a_few_percent_of_a_large_host(spark):
    rows = [(k, f"{prose(k, 8)}\n" + ("All rights reserved." if k % 30 == 0 else prose(999 + k, 4)),
             "en", "large") for k in range(300)]
    got = line_dedup.drop_boilerplate(documents(spark, rows)).where("n_dropped > 0").collect()
    assert {r["doc_id"] for r in got} == set(range(0, 300, 30))   # 10 of 300 pages
    assert all(r["text"] == prose(r["doc_id"], 8) for r in got)


# --- quality -------------------------------------------------------------------------------------

def features(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def quality_rows():
    repeats = " ".join(["a b c d e f g h i"] * 6)
    return odd_rows() + [
        (20, "x " * 50, "en", "s"), (21, repeats, "en", "s"), (22, f"{prose(5, 40)} {repeats}",
                                                               "en", "s"),
        (23, "#a# $b% <c> |d| &e*\n#a#\n#a#", "en", "s"), (24, "\x0bword\x0c" * 30, "en", "s"),
        (25, " ".join(map(str, range(8))), "en", "s"), (26, "same line\n" * 30, "en", "s")]


def test_base_rules(spark):
    rows = quality_rows()
    got = quality.judge(documents(spark, rows, extra=True))
    found = sorted((tuple(r) for r in got.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed").collect()), key=repr)
    assert found == sorted(((r[0], *features(r[1])) for r in rows), key=repr)
    assert got.where("base_failed and kept").count() == 0


def test_divergence(spark):
    p, q = [3, 0, 5, 2], [1, 1, 1, 1]
    df = spark.createDataFrame([(p, q), (p, p), (p, [0] * 4)], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)
    assert got[0] == pytest.approx(js(p, q)) and got[1] == 0 and got[2] is None


def test_junk_goes_and_prose_stays(spark):
    good = [(k, " ".join(f"the {w} of and" for w in prose(k, 30).split()), "en", "s")
            for k in range(40)]
    bad = [(100, " ".join(w.upper() + "!!##" for w in prose(9, 60).split()), "en", "s")]
    short = [(101, " ".join(w.upper() + "!!##" for w in prose(9, 25).split()), "en", "s")]
    kept = {r["id"]: r["kept"] for r in quality.judge(documents(spark, good + bad + short)).collect()}
    assert not kept[100] and all(kept[k] for k in range(40)) and kept[101]   # too short to judge


def test_menus_go(spark):
    def menu(k):
        return " | ".join(w.title() for w in prose(k, 90).split() if w[:-1].isalpha()
                          or w[0] not in "toia")
    good = [(k, ". ".join(" ".join(f"the {w} of and" for w in prose(50 * k + s, 5 + k % 4).split())
                          for s in range(3 + k % 7)), "en", "s") for k in range(80)]
    menus = [(500 + k, menu(k), "en", "s") for k in range(6)]
    # Many copies of one menu weigh as one text.
    copies = [(900 + k, menu(77), "en", "s") for k in range(150)]
    judged = quality.judge(documents(spark, good + menus + copies)).collect()
    kept = {r["id"]: r["kept"] for r in judged}
    assert not any(r["base_failed"] for r in judged)
    assert all(kept[k] for k in range(80))
    assert not any(kept[r[0]] for r in menus + copies)


def test_quality_of_nothing(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


# --- exact dedup ---------------------------------------------------------------------------------

def kept_texts(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1] or "")].append(r)
    rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    out = []
    for norm, group in groups.items():
        best = min(group, key=rank)
        for r in group:
            out.append((r[0], best[0], len(group), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files_per_batch,digest", [
    (None, exact_dedup.text_digest), (1, exact_dedup.text_digest),
    # A digest of one character: texts collide and have to be told apart by their bytes.
    (2, lambda text: F.substring(F.sha2(text, 256), 1, 1))])
def test_exact(spark, tmp_path, files_per_batch, digest):
    rows = odd_rows() + [(50 + k, f"te xt {k % 5}" + " " * (k % 3), "en", "s") for k in range(20)]
    path = f"{tmp_path}/docs"
    documents(spark, rows, extra=True).repartition(4).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, files_per_batch=files_per_batch, digest=digest,
                                  copies_per_task=3)
    found = [tuple(r) for r in got.select("id", "keep_id", "group_size", "digest").collect()]
    expected = kept_texts(rows)
    assert sorted((r[:3] for r in found), key=repr) == sorted((r[:3] for r in expected), key=repr)
    if digest is exact_dedup.text_digest:
        assert sorted(found, key=repr) == expected
    assert got.where("kept").count() == len({r[3] for r in expected})


def test_exact_goes_on_where_it_stopped(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    documents(spark, [(5, "a b"), (6, "c")]).coalesce(1).write.parquet(path)
    exact_dedup.exact_dedup(spark, path, checkpoint=state).count()
    documents(spark, [(1, "ab"), (7, "c ")]).coalesce(1).write.mode("append").parquet(path)
    got = exact_dedup.exact_dedup(spark, path, checkpoint=state)
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in got.collect()} == {
        (5, 5, 2), (1, 5, 2), (6, 7, 2), (7, 7, 2)}


def test_exact_reads_files_that_come_late(spark, tmp_path):
    path, state, late = tmp_path / "docs", f"{tmp_path}/state", 200 * 86400
    documents(spark, [(5, "a b"), (6, "c")]).coalesce(1).write.parquet(str(path))
    exact_dedup.exact_dedup(spark, str(path), checkpoint=state).count()
    before = {*path.glob("*.parquet")}
    documents(spark, [(1, "ab"), (7, "new")]).coalesce(1).write.mode("append").parquet(str(path))
    for file in {*path.glob("*.parquet")} - before:
        os.utime(file, (time.time() - late,) * 2)
    got = exact_dedup.exact_dedup(spark, str(path), checkpoint=state)
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in got.collect()} == {
        (5, 5, 2), (1, 5, 2), (6, 6, 1), (7, 7, 1)}


def test_exact_fails_on_a_document_that_is_not_in_the_state(spark, tmp_path, monkeypatch):
    path, state = tmp_path / "docs", f"{tmp_path}/state"
    documents(spark, [(5, "a b")]).coalesce(1).write.parquet(str(path))
    exact_dedup.exact_dedup(spark, str(path), checkpoint=state).count()
    before = {*path.glob("*.parquet")}
    documents(spark, [(7, "new")]).coalesce(1).write.mode("append").parquet(str(path))
    for file in {*path.glob("*.parquet")} - before:
        os.utime(file, (time.time() - 200 * 86400,) * 2)
    monkeypatch.setattr(exact_dedup, "MAX_FILE_AGE", "7d")
    with pytest.raises(Exception, match="the state lacks the digest"):
        exact_dedup.exact_dedup(spark, str(path), checkpoint=state).collect()


def test_exact_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/docs")
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/docs").count() == 0


# --- mixing --------------------------------------------------------------------------------------

def shared(budget, children):
    """children: name -> (weight, capacity). Rounds until nobody is over capacity."""
    full, rest = {}, dict(children)
    while True:
        left = budget - sum(full.values())
        weight = sum(w for w, _ in rest.values())
        over = {n: c for n, (w, c) in rest.items() if w and left * w >= c * weight}
        if not over:
            return full | {n: left * w // weight if w else 0 for n, (w, _) in rest.items()}
        # Those with the least capacity for their weight fill up first.
        name = min(over, key=lambda n: (rest[n][1] / rest[n][0], n))
        full[name] = rest.pop(name)[1]


def mixture(rows, weights, budget, epochs, seed):
    size = lambda r: -(-len((r[1] or "").encode()) // 4)
    leaf = defaultdict(int)
    for r in rows:
        leaf[(r[2] or "", r[3] or "")] += size(r)
    cap = defaultdict(int)
    for (lang, _), n in leaf.items():
        cap[lang] += n * epochs
    top = shared(min(budget, sum(cap.values())), {k: (weights.get(k, 1), c)
                                                  for k, c in cap.items()})
    out = []
    for lang in cap:
        budgets = shared(top[lang], {s: (1, n * epochs) for (k, s), n in leaf.items() if k == lang})
        for source, given in budgets.items():
            tokens = leaf[(lang, source)]
            whole, part = divmod(given, tokens) if tokens else (epochs, 0)
            places = defaultdict(list)
            for r in rows:
                if (r[2] or "", r[3] or "") == (lang, source):
                    place = f"{seed}:{whole}:{'' if r[0] is None else r[0]}"
                    places[hashlib.md5(place.encode()).hexdigest()].append(r)
            used = 0
            for place in sorted(places):
                used += sum(map(size, places[place]))
                extra = int(part > 0 and used <= part)
                out.extend((r[0], size(r), whole + extra, given) for r in places[place])
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [0, 500, 3000, 9000, 10**9])
def test_mixture(spark, budget):
    rows = odd_rows() + [(100 + k, prose(k, 10 + k % 40), "en" if k % 3 else "fr", f"s{k % 4}")
                         for k in range(120)]
    weights = {"en": 3, "fr": 1, "de": 0}
    level = F.col("lang")
    column = F.when(level == "en", 3).when(level == "de", 0).otherwise(1)
    got = mixing.mix(documents(spark, rows, extra=True),
                     {"lang": F.col("lang"), "source": F.col("source")}, {"lang": column},
                     budget=budget, max_epochs=3, seed=5, range_rows=7)
    found = sorted((tuple(r) for r in got.select(
        "doc_id", "n_tokens", "copies", "leaf_budget").collect()), key=repr)
    assert found == mixture(rows, weights, budget, 3, 5)
    assert "domain" in got.columns and "host" in got.columns


def test_mixture_of_nothing(spark):
    got = mixing.mix(spark.createDataFrame([], SCHEMA), {"lang": F.col("lang")}, {})
    assert got.count() == 0
