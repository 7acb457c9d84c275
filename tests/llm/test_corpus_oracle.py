"""Corpus queries against their SQL, on whole tables."""

from __future__ import annotations

import pytest

from remitframe.llm import queries
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, queries.queries()[name],
                   queries.oracle_sql()[name], SF_DIR)
