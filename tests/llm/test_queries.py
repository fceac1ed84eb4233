"""Every training-data query runs on the smallest tables, and its SQL gives the same rows."""

import glob
import os

import pytest

from engramlake.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["neuron_a", "neuron_b"], "p2_found": ["neuron_a", "neuron_b"], "p3_found": ["file_id", "section_no"], "p4_found": ["neuron_a", "neuron_b"], "p5_found": ["neuron_id", "kind"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos"],
}
#: Rows that each query must at least give there; p4 needs pairs that come eight times.
LEAST = {"p4_found": 0, "p4_lift": 0, "p8_reparameterised": 0}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) >= LEAST.get(name, 1)
    if name in Q.ORACLE_SQL:
        cur = duck.execute(Q.ORACLE_SQL[name])
        cols = [c[0] for c in cur.description]
        near = lambda v: round(v, 4) if isinstance(v, float) else v
        assert sorted([near(r[c]) for c in cols] for r in rows) == sorted([near(v) for v in r] for r in cur.fetchall())
