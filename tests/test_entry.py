"""The entry point without the optional part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
# Blocks one library before anything is imported and lists the queries that are left.
SCRIPT = """
import sys, warnings
sys.modules[sys.argv[1]] = None
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(*sorted(entry.queries()))
assert set(entry.oracle_sql()) <= set(entry.queries())
"""


def names(blocked: str) -> set[str]:
    done = subprocess.run([sys.executable, "-c", SCRIPT, blocked], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


@pytest.mark.parametrize("library", ["zstandard", "xxhash", "tokenizers", "tiktoken", "tabaudit.llm", "corpus_pipeline"])
def test_the_other_queries_stay(library):
    from tabaudit.catalog import QUERIES, load_all

    load_all()
    found = names(library)
    assert set(QUERIES) <= found
    if library in ("tabaudit.llm", "corpus_pipeline"):
        assert found == set(QUERIES)
