"""The entry points do without the operators of vendastat.llm, whatever keeps them from being imported."""

import importlib
import sys
import warnings

import pytest

from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES


@pytest.mark.parametrize("missing", ["vendastat.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without_the_operators(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("vendastat.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        entry = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLE_SQL
