"""The pN_ queries against SQL where there is some, and on the smallest tables."""

import pytest

from quillon.llm.queries import QUERIES, SQL
from tests.oracle import rows_by_sql, rows_of

FOUND = {
    "p1_found": {"path"}, "p2_found": {"id_a", "id_b"}, "p3_found": {"query_id", "chunk_id"}, "p4_found": {"item_id", "neighbour_id"}, "p5_found": {"id"}, "p6_found": {"path"},
    "p7_found": {"id", "piece_no", "first_line", "last_line"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_by_sql(data, SQL[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, data, name):
    columns, rows = rows_of(QUERIES[name](spark, data))
    assert set(columns) == FOUND[name]
    assert rows and max(rows.values()) == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(FOUND)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_recall(spark, data):
    row = QUERIES["p4_recall"](spark, data.replace("sf0.001", "sf0.01")).first()
    assert row.recall >= 0.95
