"""Every pN_ query runs over the smallest tables; those with SQL equal it."""

from __future__ import annotations

import pytest

from sievework.llm import queries as Q
from tests.oracle import differs


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, small, name):
    df = Q.queries()[name](spark, small)
    if name in Q.oracle_sql():
        assert differs(df, Q.oracle_sql()[name], small) is None
    else:
        assert df.count() >= 0


COLUMNS = {
    "p1_found": [("doc_id_a", "string"), ("doc_id_b", "string")], "p2_found": [("doc_id", "string")], "p3_found": [("domain", "string")], "p4_found": [("domain", "string"), ("doc_id", "string")], "p5_found": [("doc_id", "string"), ("chunk_idx", "int")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "string")], "p7_found": [("source", "string")], "p8_found": [("doc_id", "bigint"), ("lang", "string")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    assert Q.queries()[name](spark, small).dtypes == COLUMNS[name]
