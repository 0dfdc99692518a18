"""The queries over the smallest tables, and the one that SQL can state."""

import os

import pytest

from thicket.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["load_id", "line_no", "noise_kind"], "p3_found": ["tab", "row_key"], "p4_found": ["id_a", "id_b"], "p5_found": ["tab", "id_a", "id_b"],
    "p6_found": ["tab", "row_key", "pii_type", "start_pos"], "p7_found": ["window_id", "doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_p3_sql(spark):
    import duckdb

    d = duckdb.connect()
    for t in ("loaded_docs", "chunks", "size_limits"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(d.sql(queries.SQL["p3_found"]).fetchall()) == sorted(map(tuple, queries.p3_found(spark, SF).collect()))
