"""The driver contract, with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "remitframe.llm"])
def test_entry_without_corpus_operators(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "names = set(e.queries()); assert 'claims' in names and set(e.oracle_sql()) <= names; "
            "assert 'pipeline' not in names and not any(n.startswith('op') for n in names)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_other_import_errors_are_not_hidden():
    code = ("import sys; sys.modules['starcheck.oracle'] = None\n"
            "try:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(0)\nsys.exit(1)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
