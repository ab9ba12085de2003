"""The training-data queries with SQL against it, and the columns of all, on the smallest tables."""

import os

import pytest

pytest.importorskip("vellum.llm")
from tests.test_queries import DIR, con, rows  # noqa: E402, F401
from vellum.llm.queries import oracle_sql, queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
COLUMNS = {
    "p1_found": {"doc_id_a", "doc_id_b"}, "p3_found": {"book_filename", "start_char"}, "p4_found": {"conv_id", "pair_no", "defect"},
    "p5_found": {"doc_id", "kind"}, "p6_found": {"doc_id", "line_no", "kind"}, "p9_found": {"doc_id", "seg_no", "lang"},
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, con, name):  # noqa: F811
    df = queries()[name](spark, DIR)
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_rows_are_distinct(spark, name):
    df = queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    assert set(df.columns) == COLUMNS[name] and got and len(got) == len(set(got))
