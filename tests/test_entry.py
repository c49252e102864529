import importlib
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert {*entry.oracle_sql()} <= {*entry.queries()} and len(entry.queries()) > 80


def test_library_does_not_import_the_subpackage():
    own = [p for p in Path(entry.__file__).parent.joinpath("weft").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in own if "weft.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]


def test_entry_imports_without_the_subpackage(monkeypatch):
    for name in ("weft.llm", "weft.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    plain = importlib.import_module("__spark_entry__")
    assert not [k for k in plain.queries() if k.startswith("op")] and "meta_pool_random_effects" in plain.queries()


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
