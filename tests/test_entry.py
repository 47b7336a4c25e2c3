"""The entry module works with and without the training-data folders."""

import importlib.util

import __spark_entry__ as entry


def test_queries_without_the_training_data_folders(monkeypatch):
    real = importlib.util.find_spec
    gone = ("tidemark.llm", "corpus_pipeline")
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(gone) else real(name, *a))
    assert len(entry.queries()) > 140 and set(entry.oracle_sql()) <= set(entry.queries())
    assert not [k for k in entry.queries() if k == "pipeline" or k.startswith("op1")]
