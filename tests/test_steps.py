"""Encoding steps, links, retrievers and word rules on small cases, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.functions import text as T
from engramlake.operators import changelog, encoding, linking, memory, scans, stats
from engramlake.plans import encode, recall
from engramlake.sources import readers

DAY = dt.datetime(2025, 3, 12, 15, 30)
DOC = "doc_id bigint, text string, created_at timestamp_ntz, extra int"


def test_tokens_of_all_scripts(spark):
    rows = [("Größe 12x ab", ["größe", "12x"]), ("длинные трассы", ["длинные", "трассы"]), ("同步中心 ok run", ["run", "同步", "步中", "中心"]), ("記", ["記"]), ("", []), (None, None), ("एकता कड़ी", ["एकता", "कड़ी"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", S.search_tokens(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_near_hashes_equal_brute_force(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(40)]
    hashes = base + [h ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 13))) for h in base] + [0]
    rows = [(f"n{i:03d}", h) for i, h in enumerate(hashes)] + [("n000", hashes[0]), ("zz", hashes[1]), ("x", None), (None, 5)]
    df = spark.createDataFrame(rows, "id string, content_hash bigint")
    for limit in (0, 3, 7, 10):
        want = {(f"n{a:03d}", f"n{b:03d}") for a in range(80) for b in range(a + 1, 80) if 0 < (hashes[a] ^ hashes[b]).bit_count() <= limit}
        assert {(x.a, x.b) for x in scans.near_hashes(df, limit=limit).collect()} == want
    with pytest.raises(ValueError):
        scans.near_hashes(df, limit=16)


def test_near_hashes_make_no_row_for_a_flip(spark, monkeypatch):
    r = random.Random(5)
    base = [r.getrandbits(64) - 2**63 for _ in range(150)]
    hashes = base + [(h ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 16)))) for h in base]
    df = spark.createDataFrame([(f"n{i:03d}", h) for i, h in enumerate(hashes)], "id string, content_hash bigint")
    sizes = []
    monkeypatch.setattr(type(df), "repartition", lambda self, *a, _was=type(df).repartition: (sizes.append(self.count()), _was(self, *a))[1])
    for unit, limit in ((scans.UNIT, 10), (50, 10), (50, 7), (1000, 15), (1, 3)):
        monkeypatch.setattr(scans, "UNIT", unit)
        monkeypatch.setattr(scans, "PAIRS", 7 if unit == 50 else 1 << 21)
        apart = {(f"n{a:03d}", f"n{b:03d}"): ((hashes[a] ^ hashes[b]) & (2**64 - 1)).bit_count() for a in range(300) for b in range(a + 1, 300)}
        got = scans.near_hashes(df, limit=limit)
        assert [(x.a, x.b, x.distance) for x in got.orderBy("a", "b").collect()] == [(*k, d) for k, d in sorted(apart.items()) if d <= limit]
    # 548 rows a hash, of which the engine may make a broadcast, are what the driver's memory did not hold
    assert sizes and sizes[0] <= 300 * 4 * 7


def test_semantic_links_equal_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 8))
    v = {f"n{i:02d}": (centres[i % 6] + 0.4 * r.standard_normal(8)).tolist() for i in range(60)}
    rows = [(k, "concept" if i % 3 else "entity", "text", x) for i, (k, x) in enumerate(v.items())] + [("time", "time", "text", v["n00"]), ("blank", "concept", " ", v["n00"]), ("none", "concept", "text", None), ("zero", "concept", "text", [0.0] * 8)]
    neurons = spark.createDataFrame(rows, "id string, type string, content string, embedding array<double>")
    synapses = spark.createDataFrame([("n06", "n00")], "source_id string, target_id string")
    m = np.array(list(v.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = m @ m.T
    want = set()
    for i in range(60):
        near = sorted(((-cos[i, j], j) for j in range(60) if j != i and cos[i, j] >= 0.7))[:5]
        want |= {(f"n{min(i, j):02d}", f"n{max(i, j):02d}") for _, j in near}
    assert {(x.a, x.b) for x in linking.semantic_links(neurons, synapses, size=8).collect()} == want - {("n00", "n06")}
    assert linking.semantic_links(neurons.limit(0), synapses, size=8).count() == 0


def test_compressed_forms(spark):
    rows = [(["Anna", "", "Rome"], ["visited"], "Nothing here. Anna went to Rome. Anna slept. All is well."), (["Anna"], [], "Anna"), ([], [], ""), (["a", "b", "c"], ["x"], "no match at all")]
    df = spark.createDataFrame(rows, "c array<string>, r array<string>, t string")
    got = df.select(linking.template(F.col("c"), F.col("r")).alias("z"), linking.entity_preserving(F.col("t"), F.col("c")).alias("y"), linking.extractive(F.col("t"), F.col("c"), 2).alias("x")).collect()
    assert [r.z for r in got] == ["Anna visited Rome", "Anna", "", "a x b; b x c"]
    assert [r.y for r in got] == ["Anna went to Rome. Anna slept.", "Anna", "", "no match at all"]
    assert [r.x for r in got] == ["Nothing here. Anna went to Rome.", "Anna", "", "no match at all"]  # of equally dense ones the first


def test_encoding_steps_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "We moved old files. I need to call home soon!", DAY, 0), (2, " we moved old files. I need to call home soon! ", DAY + dt.timedelta(1), 0), (3, None, None, 0), (4, "", DAY, 0), (5, "great great bad", None, 0)], DOC)
    assert {(r.doc_id, r.target) for r in encoding.actions(docs).collect()} == {(1, "moved old files"), (2, "moved old files")}
    assert {(r.doc_id, r.target) for r in encoding.goals(docs).collect()} == {(1, "call home soon"), (2, "call home soon")}
    assert [(r.doc_id, r.original) for r in encoding.copies(docs).collect()] == [(2, 1)]
    assert [(r.doc_id, r.state, r.weight) for r in encoding.feelings(docs, memory.sentiment(F.col("text"))).collect()] == [(5, "positive", round(0.8 / 3, 6))]
    out = encode.encode(docs)
    assert {k: v.count() for k, v in out.items()}["anchors"] == 3 and len(out) == 17
    assert all(v.count() == 0 for v in encode.encode(docs.limit(0)).values())


def test_shared_entity_links_keep_their_bounds(spark):
    mentions = [(d, "hub") for d in range(60)] + [(d, "rare") for d in range(10)] + [(3, "pair"), (9, "pair")]
    got = {(r.doc_id, r.other): r.weight for r in encoding.shared_entity_links(spark.createDataFrame(mentions, "doc_id bigint, entity string")).collect()}
    assert got[9, 3] == 0.3 and got[9, 8] == 0.3 and (9, 2) not in got and (50, 49) not in got


def test_times_and_decisions(spark):
    said = ["day before yesterday", "see it yesterday", "3 days ago", "this week", "last month", "next year", "no time", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", memory.time_range(F.col("t"), F.lit(DAY).cast("timestamp_ntz")).alias("r")).collect()
    d = lambda *x: dt.datetime(*x)
    want = [(d(2025, 3, 10), d(2025, 3, 11)), (d(2025, 3, 11), d(2025, 3, 12)), (d(2025, 3, 9), d(2025, 3, 10)), (d(2025, 3, 10), d(2025, 3, 17)), (d(2025, 2, 1), d(2025, 3, 1)), (d(2026, 1, 1), d(2027, 1, 1)), None, None]
    assert {r.i: r.r and (r.r.start, r.r.end) for r in got} == dict(enumerate(want))
    docs = spark.createDataFrame([(1, "The decision on Caching was redis. We decided to use Spark for batch.", DAY, 0), (2, "the choice for caching is memcached", DAY + dt.timedelta(1), 0), (3, "use tabs instead of spaces", DAY, 0), (4, None, DAY, 0)], DOC)
    claims = memory.decisions(docs)
    assert {(r.doc_id, r.subject, r.value) for r in claims.collect()} == {(1, "caching", "redis"), (1, "batch", "spark"), (2, "caching", "memcached"), (3, "spaces", "tabs")}
    assert [(r.subject, r["values"]) for r in memory.conflicts(claims).collect()] == [("caching", 2)]
    assert {(r.doc_id, r.standing) for r in memory.resolve(claims).collect()} == {(1, "superseded"), (1, "agreed"), (2, "holds"), (3, "agreed")}


def test_spelling_retriever(spark):
    neurons = spark.createDataFrame([("a", "session log"), ("b", "sesion"), ("c", "passion"), ("d", None), ("e", "sessions here")], "id string, content string").withColumn("type", F.lit("concept"))
    asked = spark.createDataFrame([(1, "session"), (2, "here we are"), (3, "")], "query_id int, query string")
    assert {(r.query_id, r.neuron_id) for r in recall.by_spelling(asked, neurons).collect()} == {(1, "b"), (1, "e")}
    assert recall.by_spelling(asked, neurons.limit(0)).count() == 0


def test_code_symbols(spark):
    python = "import os\nfrom a import b\nLIMIT = 3\nclass K:\n    def run(self): pass\ndef free(x): return x\nvalue = 1\n"
    rows = [("x.py", python), ("y.go", "func Run() {}\ntype A struct {}\nstruct B {}"), ("z.md", "text\n```py\nn = 1\n```\n```sh\nls\n```\ndef no(): pass"), ("bad.py", "def broken(:\n"), ("n.py", None)]
    got = {(r.path, r.kind, r.name, r.parent) for r in readers.code_symbols(spark.createDataFrame(rows, "path string, body string")).collect()}
    assert got == {
        ("x.py", "import", "os", None), ("x.py", "import", "a.b", None), ("x.py", "constant", "LIMIT", None), ("x.py", "class", "K", None), ("x.py", "method", "run", "K"), ("x.py", "function", "free", None), ("x.py", "variable", "value", None),
        ("y.go", "function", "Run", None), ("y.go", "class", "B", None), ("z.md", "variable", "n", None), ("bad.py", "function", "broken", None),
    }


def test_health_by_hand(spark):
    neurons = spark.createDataFrame([(f"n{i}", "b") for i in range(4)], "id string, brain_id string")
    synapses = spark.createDataFrame([("b", "n0", "n1", "related_to", 0.5), ("b", "n1", "n2", "alias", 0.5), ("b", "n0", "n2", "contradicts", 0.5)], "brain_id string, source_id string, target_id string, type string, weight double")
    fibers = spark.createDataFrame([("b", "f0", ["x"], None, DAY, DAY, 20), ("b", "f1", None, None, None, DAY - dt.timedelta(30), 0), ("b", "f2", ["code_index"], None, DAY, DAY, 0)], "brain_id string, id string, auto_tags array<string>, agent_tags array<string>, last_conducted timestamp_ntz, created_at timestamp_ntz, frequency int")
    members = spark.createDataFrame([("f0", "n0")], "fiber_id string, neuron_id string")
    states = spark.createDataFrame([("n0", 3), ("n1", 0), ("n2", 0), ("n3", 0)], "neuron_id string, access_frequency int")
    r = stats.health(neurons, synapses, members, fibers, states, now="2025-03-12 16:00:00").first()
    connectivity = 1 / (1 + np.exp(-1.5 * (2 / 4 - 3)))
    diversity = np.log(3) / np.log(8)
    score = 100 * (0.25 * connectivity + 0.2 * diversity + 0.15 * 0.5 + 0.15 * 0 + 0.1 * 0.75 + 0.1 * 0.25 + 0.05 * 0.5) - 10
    assert abs(r.score - score) < 1e-3 and r.penalty == 10.0 and r.grade == ("F" if score < 40 else "D")


def test_held_state_and_sent_receipts(spark):
    row = lambda i, s, op, sent: (i, f'{{"entity_type":"n","entity_id":"e","operation":"{op}","sequence":{s},"synced":{sent}}}')
    log = spark.createDataFrame([row("a", 1, "insert", "true"), row("b", 2, "update", "false"), row("c", 4, "update", "false"), row("b", 2, "update", "true"), ("d", "{")], "receipt_id string, change string")
    assert [r.receipt_id for r in changelog.replay(log, gaps="hold").collect()] == ["b"]
    assert [r.receipt_id for r in changelog.replay(log).collect()] == ["c"]
    assert {r.receipt_id: r.synced for r in changelog.synced_receipts(log).collect()} == {"a": True, "b": True, "c": False}


def test_repetitive_texts(spark):
    rows = [("again and again this " * 6,), ("every single word differs from what came before within these dozen plain parts",), (None,), ("short",)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").select(T.repetitive(F.col("t")).alias("x")).collect()] == [True, False, False, False]


def test_similar_sets_with_a_hot_item(spark, monkeypatch):
    from engramlake.operators import clusters

    monkeypatch.setattr(clusters, "SPLIT", 4)
    r = random.Random(8)
    sets = {f"s{i:02d}": {"hub", *r.sample("abcdefgh", r.randrange(0, 4))} for i in range(40)}
    rows = [(k, x) for k, v in sets.items() for x in v]
    got = {(x.a, x.b) for x in clusters.set_similarity(spark.createDataFrame(rows, "set_id string, item string"), threshold=0.5).collect()}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    reps = sorted(first.values())
    assert got == {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def test_mean_strengths_do_not_depend_on_the_order_of_rows(spark):
    # the mean is 0.6230625; sums of floats in other orders are a little more or less
    values = [0.931, 0.874, 0.755, 0.512, 0.303, 0.641, 0.222, 0.987, 0.118, 0.777, 0.69, 0.431, 0.816, 0.555, 0.604, 0.753]
    r, rows = random.Random(3), []
    for k in range(200):
        r.shuffle(values)
        rows += [(f"a{k:03d}", "b", v) for v in values]
    rows += [("x", "y", None), ("x", "z", float("nan")), ("x", "z", 0.5), ("x", "w", 2e12), ("x", "w", 1.0), ("w", "x", None)]
    co = spark.createDataFrame(rows, "neuron_a string, neuron_b string, binding_strength double").coalesce(1)
    got = {(x.a, x.b): (x.n, x.strength) for x in stats.co_activation_counts(co).collect()}
    assert {v for (a, _), v in got.items() if a[0] == "a"} == {(16, 0.623063)}
    assert got["x", "y"] == (1, None) and math.isnan(got["x", "z"][1]) and got["w", "x"] == (3, 1000000000000.5)


def test_word_sets_make_rows_only_of_similar_pairs(spark, monkeypatch):
    from engramlake.operators import clusters

    r = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    sets = {k: {words[int(200 * r.random() ** 3)] for _ in range(r.randrange(1, 60))} for k in range(300)}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v] + [(0, None), (None, "w1")], "set_id bigint, item string")
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    reps = sorted(first.values())
    for threshold, group, cells, frequent in ((0.25, 32768, 1 << 22, 0.02), (0.25, 150, 1, 1), (0.5, 40, 500, 0.3)):
        monkeypatch.setattr(clusters, "GROUP", group)
        monkeypatch.setattr(clusters, "CELLS", cells)
        monkeypatch.setattr(clusters, "FREQUENT", frequent)
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        got = clusters.text_set_similarity(rows, threshold=threshold)
        assert {(x.a, x.b): x.jaccard for x in got.collect()} == pytest.approx(want)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for a pair that only meets
