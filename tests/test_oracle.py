"""Registered queries against SQL over the same tables, at the smallest scale."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from starcheck import oracle
from starcheck import queries as star
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name, entry.queries()[name], SQL[name], SF)


def test_archived_text_of_real_files(spark):
    """Every segment of every accepted file, against the files' bytes."""
    folder = star.edi_folder(spark, SF)
    expected, marks = {}, {}
    for path in Path(folder.removeprefix("file:")).glob("upload_seq=*/part.edi"):
        seq = int(path.parent.name.split("=")[1])
        content = path.read_bytes().decode("latin-1" if seq % 6 == 1 else "utf-8")
        mark = marks[seq] = content[content.index("ISA") + 105]
        texts = [t for t in (part.strip() for part in content.split(mark)) if t]
        digest = 0
        for k, t in enumerate(texts, 1):
            digest ^= int(hashlib.md5(f"{k}:{t}".encode()).hexdigest()[:15], 16)
        expected[seq] = (len(texts), sum(map(len, texts)), digest)
    store = star.file_store(spark, SF)
    good = {r.upload_seq for r in store.read("ingest_summary").where("success").collect()}
    got = {r.upload_seq: (r.segments, r.chars, r.digest)
           for r in entry.queries()["files_text"](spark, SF).collect()}
    assert got == {k: v for k, v in expected.items() if k in good} and len(got) == 3
    assert {"\n", "\x1d"} <= set(marks.values())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
