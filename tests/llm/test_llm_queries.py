"""The llm queries run on the smallest test tables, and agree with their SQL where there is one."""

import glob
import os

import pytest

from siltstone.llm.queries import QUERIES
from siltstone.llm.sql import SQL
from siltstone.llm.tokens import TOKENIZERS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name.startswith(("p8_", "p9_")) and not os.path.isdir(TOKENIZERS):
        pytest.skip("no public tokenizers here")
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in SQL:
        import duckdb

        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for path in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        cursor = con.execute(SQL[name])
        assert [c[0] for c in cursor.description] == df.columns
        assert sorted(rows) == sorted(cursor.fetchall())


COLUMNS = {
    "p1_found": {"chunk_id": "string"}, "p2_found": {"extract_id": "bigint", "line_no": "int"}, "p4_found": {"record_table": "string", "record_id": "string", "kind": "string"},
    "p5_found": {"point_id_a": "string", "point_id_b": "string"}, "p6_found": {"record_table": "string", "record_id": "bigint", "unit_no": "int"}, "p7_found": {"document_id_a": "string", "document_id_b": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    if name == "p8_ids" and not os.path.isdir(TOKENIZERS):
        pytest.skip("no public tokenizers here")
    assert dict(QUERIES[name](spark, data).dtypes) == COLUMNS[name]
