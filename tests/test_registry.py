import importlib.util

import pytest

import __spark_entry__ as e
from citeloom.plans import registry


def test_names_and_oracles():
    q, o = e.queries(), e.oracle_sql()
    assert len(registry.queries()) > 110 and set(o) <= set(q)


def test_the_rest_works_without_the_optional_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "citeloom.llm" else real(n, *a))
    assert set(e.queries()) == set(registry.queries())


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(e.__file__).parent / "citeloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "citeloom.llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["check_references", "p4_report", "density", "bm25_topk"])
def test_queries_run_on_the_smallest_tables(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0
