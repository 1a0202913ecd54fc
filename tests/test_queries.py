"""Every query of the reference's operators over the smallest tables; those with SQL equal it."""

from __future__ import annotations

import pathlib
import re

import pytest

from sievework.plans import catalog
from tests.oracle import differs

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert differs(df, SQL[name], small) is None
    else:
        assert df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_training_data_package():
    root = pathlib.Path(__file__).resolve().parents[1]
    for p in (root / "sievework").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(?:from|import)\s+\S*\bllm\b", p.read_text()), p
