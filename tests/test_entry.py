import importlib

import pytest


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["field", "dim", "n", "mean", "std", "min", "max"] and df.count() == 4


def test_registries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "chunk_delta_stats" in names


def test_works_without_the_llm_parts(monkeypatch):
    import sys

    entry = importlib.import_module("__spark_entry__")
    for name in [n for n in sys.modules if n.startswith("trajecta.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "trajecta.llm", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("trajecta.llm.queries")
    try:
        alone = importlib.reload(entry)
        assert alone.llm is None and "repack" in alone.queries() and "pipeline" not in alone.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
