"""Every core query runs on the smallest tables, and its SQL gives the same rows."""

import glob
import math
import os

import pytest

from engramlake import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: Queries that may find nothing in the smallest tables.
EMPTY = set("p6_held p6_held_fields scan_match_tokens scan_match_script_tokens scan_exact_batch scan_suggest scan_find_neurons scan_adjacency scan_find_fibers scan_fibers_of scan_fiber_valid_at scan_synapses cluster_fan_effect encode_same_content fn_hash_pairs fn_levenshtein fn_near_hashes graph_neighbours_in graph_spread_intersection graph_transitive_closures memory_conflicts memory_recent_cooccurrence merge_changes_since recall_by_entity recall_by_graph recall_by_time scan_expiring_memories scan_geo_within seq_temporal_links text_repetitive".split())


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    assert rows or name in EMPTY
    if name in Q.ORACLE_SQL:
        cur = duck.execute(Q.ORACLE_SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        got = sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in (x.asDict(True) for x in rows))
        want = sorted(repr([norm(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
        assert got == want


def test_components_over_all_synapses(spark, duck):
    above = {}

    def find(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in duck.execute("SELECT source_id, target_id FROM synapses WHERE source_id IS NOT NULL AND target_id IS NOT NULL").fetchall():
        low, high = sorted((find(a), find(b)))
        above[high] = low
    want = {x: find(x) for x in above}
    assert {r.node: r.component for r in Q.QUERIES["graph_components"](spark, SF).collect()} == want
    largest = max(list(want.values()).count(c) for c in set(want.values()))
    n = duck.execute("SELECT count(DISTINCT id) FROM neurons").fetchone()[0]
    assert tuple(Q.QUERIES["graph_largest_component"](spark, SF).first()) == (largest, round(largest / n, 6))


def test_queries_take_all_rows(spark, duck):
    def count(sql):
        return duck.execute(f"SELECT count(*) FROM {sql}").fetchone()[0]

    assert Q.QUERIES["text_essence"](spark, SF).count() == count("documents WHERE text IS NOT NULL")
    contents = dict(duck.execute("SELECT DISTINCT ON (id) id, content FROM neurons WHERE id IS NOT NULL AND content IS NOT NULL").fetchall())
    bits = {r.id: r.bits for r in Q.QUERIES["fn_char_entropy"](spark, SF).collect()}
    want = {k: -sum(c.count(x) / len(c) * math.log2(c.count(x) / len(c)) for x in set(c)) for k, c in contents.items()}
    assert bits == pytest.approx(want, abs=2e-6)
    assert {r.id: (r.p3, r.stem) for r in Q.QUERIES["fn_prefix_variants"](spark, SF).collect()} == {k: (c[:3], c[: max(0, len(c) - 2)]) for k, c in contents.items()}


def test_decisions_of_all_languages(spark):
    from engramlake.catalog import maintenance
    from types import SimpleNamespace

    texts = [("zh", "我们决定使用东京的数据库"), ("ja", "我们决定使用大阪的数据库"), ("EN", "ship Größe now"), (None, "größe ship later"), ("ru", "решено писать журнал"), ("en", "писать журнал")]
    docs = spark.createDataFrame([(i, lang, "decision", text) for i, (lang, text) in enumerate(texts)], "doc_id int, lang string, memory_type string, text string")
    got = {(r.a, r.b): r.score for r in maintenance._decisions(SimpleNamespace(documents=docs)).collect()}
    assert got == {(0, 1): round(8 / 14, 6), (2, 3): 0.5, (4, 5): round(2 / 3, 6)}
