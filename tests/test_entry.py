"""The driver contract, with and without the optional corpus subpackage."""

from __future__ import annotations

import importlib
import sys

import pytest

from tessera.suite import base


@pytest.fixture
def without_corpus(monkeypatch):
    """As if the corpus folders could not be imported; ``None`` in sys.modules makes an import fail."""
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)


def test_entry_without_the_corpus_operators(without_corpus):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() == base.QUERIES and entry.oracle_sql() == base.ORACLE
    with pytest.raises(ImportError):  # the pipeline itself swallows nothing
        importlib.import_module("corpus_pipeline")


def test_every_sql_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(base.QUERIES) <= set(entry.queries())
