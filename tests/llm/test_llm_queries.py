import pytest
from oracle import assert_same

from tessera.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p3_found": ["src", "line_no"], "p4_found": ["src", "line_no", "defect"], "p5_found": ["src", "field", "line_no"],
    "p6_found": ["split", "id_a", "id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, FOLDER, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and df.columns == COLUMNS.get(name, df.columns)
