import importlib

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for p in (root / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"tessera\.llm", p.read_text()), p
