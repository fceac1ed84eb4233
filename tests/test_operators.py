"""Operators against small cases worked out by hand or by plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict, deque

import numpy as np

from engramlake.functions import scalar as S
from engramlake.functions import text as T
from engramlake.operators import clusters, graph, maintenance, merging, ranking, scans, sequences, stats
from engramlake.plans import encode
from engramlake.sources import readers
from pyspark.sql import functions as F

EDGE = "id string, source_id string, target_id string, type string, weight double, direction string, reinforced_count int, last_activated timestamp_ntz, created_at timestamp_ntz"
DAY = dt.datetime(2025, 1, 1)


def edges(spark, rows):
    return spark.createDataFrame([(f"s{i}", a, b, k, float(w), "uni", 0, None, DAY) for i, (a, b, k, w) in enumerate(rows)], EDGE)


def test_components_of_random_graphs_and_edge_cases(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(80):02d}", f"n{r.randrange(80):02d}") for _ in range(60)] + [("loop", "loop")] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            queue = deque([start])
            while queue:
                x = queue.popleft()
                if x not in want:
                    want[x] = start
                    queue.extend(near[x])
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_spread_decays_and_respects_threshold(spark):
    e = graph.directed(edges(spark, [("a", "b", "r", 1.0), ("b", "c", "r", 0.9), ("c", "d", "r", 1.0), ("a", "x", "r", 0.05), ("a", "a", "r", 1.0)]))
    start = spark.createDataFrame([(1, "a", 1.0), (2, "unknown", 0.7)], "query_id int, node string, level double")
    got = {(r.query_id, r.node): (round(r.level, 6), r.hop) for r in graph.spread(e, start).collect()}
    assert got == {(1, "a"): (1.0, 0), (1, "b"): (0.5, 1), (1, "c"): (0.225, 2), (2, "unknown"): (0.7, 0)}


def test_spread_ends_when_little_is_new(spark):
    e = graph.directed(edges(spark, [("a", f"b{i}", "r", 1.0) for i in range(4)] + [("b0", "c", "r", 1.0), ("c", "d", "r", 1.0)]), both=False)
    start = spark.createDataFrame([(1, "a", 1.0)], "query_id int, node string, level double")
    far = lambda **o: {r.node for r in graph.spread(e, start, threshold=0.01, **o).collect()}
    assert far() == {"a", "b0", "b1", "b2", "b3", "c", "d"}
    assert far(diminishing=True) == {"a", "b0", "b1", "b2", "b3", "c"}


def test_shortest_paths(spark):
    e = graph.directed(edges(spark, [("a", "b", "r", 1), ("b", "c", "r", 1), ("a", "d", "r", 1), ("d", "c", "r", 1), ("z", "z", "r", 1)]), both=False)
    pairs = spark.createDataFrame([("a", "c"), ("a", "z"), ("a", "a")], "source string, target string")
    got = {(r.source, r.target): r.path for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {("a", "c"): ["a", "b", "c"], ("a", "a"): ["a"]}


def test_pagerank_against_dense_iteration(spark):
    rows = [("a", "b", "r", 1.0), ("b", "c", "r", 0.5), ("b", "a", "r", 0.5), ("c", "d", "r", 1.0)]
    got = {r.node: r.rank for r in graph.pagerank(graph.directed(edges(spark, rows), both=False), spark.createDataFrame([("a", 1.0)], "node string, level double"), rounds=60).collect()}
    names = ["a", "b", "c", "d"]
    p = np.zeros((4, 4))
    for a, b, _, w in rows:
        p[names.index(a), names.index(b)] += w
    out = p.sum(1, keepdims=True)
    p = np.where(out > 0, p / np.maximum(out, 1e-12), np.array([1, 0, 0, 0]))
    rank, residual = np.zeros(4), np.array([1.0, 0, 0, 0])
    for _ in range(60):
        rank, residual = rank + 0.15 * residual, 0.85 * residual @ p
    for name, value in zip(names, rank / rank.max()):
        assert abs(got[name] - value) < 1e-4


def test_chain_stops_at_cycles(spark):
    e = edges(spark, [("a", "b", "c", 0.5), ("b", "c", "c", 0.5), ("c", "a", "c", 1.0), ("b", "x", "other", 1.0)])
    assert {(r.node, r.depth, r.weight) for r in graph.chain(e, "a", ["c"]).collect()} == {("b", 1, 0.5), ("c", 2, 0.25)}
    assert graph.chain(e, "nowhere", ["c"]).count() == 0


def test_triangles_and_gromov(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}", "r", 1.0) for i in range(6)]
    e = graph.directed(edges(spark, ring + [("n0", "n2", "r", 1.0)]), both=False)
    assert graph.triangles(e).first().triangles == 1
    tree = graph.directed(edges(spark, [("r", f"l{i}", "r", 1.0) for i in range(6)]))
    got = graph.gromov_delta(tree).first()
    assert (got.delta, got.structure) == (0.0, "tree-like")


def test_fusion_levels_and_ties(spark):
    rows = spark.createDataFrame([(1, "entity", "a", 1), (1, "graph", "a", 2), (1, "graph", "b", 1), (2, "x", "c", 1)], "query_id int, retriever string, neuron_id string, rank int")
    fused = {(r.query_id, r.neuron_id): r.score for r in ranking.fuse(rows).collect()}
    assert fused[1, "a"] == round(0.9 / 61 + 0.5 / 62, 9)
    levels = {(r.query_id, r.neuron_id): r.level for r in ranking.to_levels(ranking.fuse(rows)).collect()}
    assert levels == {(1, "a"): 1.0, (1, "b"): 0.1, (2, "c"): 1.0}  # a single score is the highest


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "a", 60, 9.0), (1, "b", 60, 8.0), (1, "c", 30, 1.0)], "g int, fiber_id string, cost int, value double")
    got = [(r.fiber_id, r.spent) for r in ranking.within_budget(rows, group="g", budget=100).orderBy("pos").collect()]
    assert got == [("a", 90), ("c", 90)]


def test_keep_first_near(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 7), (1, "b", 2.0, 7), (1, "c", 1.0, -1), (1, "d", 1.0, 0), (1, "e", 1.0, None)], "g int, id string, score double, hash bigint")
    assert {r.id for r in ranking.keep_first_near(rows, group="g").collect()} == {"a", "c", "d", "e"}


def test_ranking_takes_all_rows_of_a_large_brain(spark):
    from types import SimpleNamespace

    from engramlake.catalog import ranking as catalog

    n = 10_300
    ids = spark.range(n).select(F.format_string("n%05d", "id").alias("id"), F.lit("b").alias("brain_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("type"), F.col("id").alias("i"))
    neurons = ids.select("id", "brain_id", "type", F.struct(F.lit(1).alias("priority"), F.lit(False).alias("disputed"), F.lit(False).alias("superseded")).alias("metadata"), F.lit(0).cast("bigint").alias("content_hash"))
    states = ids.select(F.col("id").alias("neuron_id"), F.when(F.col("i") < 10_000, 1.0).otherwise(0.7).alias("activation_level"))
    # 10,000 cheap fibers, then dear ones of the highest value
    fibers = ids.select("id", "brain_id", F.when(F.col("i") < 10_000, "w").otherwise(F.repeat(F.lit("w "), 150)).alias("summary"), F.when(F.col("i") < 10_000, 6.0).otherwise(9.0).alias("salience"), F.lit(0.0).alias("conductivity"), F.lit(0).alias("frequency"))
    t = SimpleNamespace(neurons=neurons, states=states, fibers=fibers)
    active = catalog._active(t)
    assert ranking.deprioritise(active, neurons).count() == n
    assert ranking.inhibit(active).count() == n
    levels = [1.0] * 10_000 + [0.7] * 300
    row = ranking.sufficiency(active).first()
    assert (row.nodes, row.entropy) == (n, round(-sum(x / sum(levels) * math.log2(x / sum(levels)) for x in levels), 6))
    assert ranking.stabilise(active).count() == n
    assert ranking.keep_first_near(catalog._scored(t), group="brain_id").count() == n
    first = ranking.prefix_budget(catalog._costs(t).withColumnRenamed("brain_id", "group"), order=[F.desc("value"), "fiber_id"], cost="cost", budget=300).collect()
    assert [x.fiber_id for x in first] == ["n10000"]
    assert ranking.within_budget(catalog._costs(t), group="brain_id", budget=10**6).count() > 10_000


def test_stabilise_against_plain_rounds(spark):
    r = random.Random(4)
    groups = {"a": [r.random() for _ in range(50)], "b": [0.01, 0.04], "c": [0.06], "d": [1.0] * 5, None: [0.3, 0.9]}
    want = {}
    for g, levels in groups.items():
        x = np.array(levels)
        for _ in range(10):
            before = x.copy()
            x[x < 0.05] = 0
            x = x * 0.85
            live = x[x > 0]
            if not len(live):
                break
            x = (x * min(3.0, 1 + 0.3 * (0.5 / live.mean() - 1))).clip(0, 1)
            if abs(x - before).max() < 0.01:
                break
        want |= {(g, f"n{i}"): round(v, 7) for i, v in enumerate(x.tolist()) if v > 0}
    rows = [(g, f"n{i}", v) for g, levels in groups.items() for i, v in enumerate(levels)]
    got = ranking.stabilise(spark.createDataFrame(rows, "query_id string, node string, level double")).collect()
    assert {(x.query_id, x.node): round(x.level, 7) for x in got} == want


def test_folds_over_large_groups(spark):
    r = random.Random(6)
    rows = [(g, f"f{i:03d}", r.randrange(1, 60), r.choice((0.5, 1.0, r.random()))) for g in (1, 2) for i in range(400)]
    want = {}
    for g in (1, 2):
        spent, taken = 0, []
        for _, name, cost in sorted((-v / c, f, c) for h, f, c, v in rows if h == g):
            if spent + cost <= 100:
                spent, taken = spent + cost, [*taken, name]
        want |= {(g, i): (f, spent) for i, f in enumerate(taken)}
    got = ranking.within_budget(spark.createDataFrame(rows, "g int, fiber_id string, cost int, value double"), group="g", budget=100).collect()
    assert {(x.g, x.pos): (x.fiber_id, x.spent) for x in got} == want

    centres = [r.getrandbits(63) for _ in range(12)]
    rows = [(g, f"n{i:03d}", r.randrange(4), r.choice(centres) ^ sum(1 << b for b in r.sample(range(63), r.randrange(9)))) for g in ("a", None) for i in range(150)]
    want = set()
    for g in ("a", None):
        kept = []
        for _, name, h in sorted((-s, i, h) for q, i, s, h in rows if q == g):
            if all((h ^ k).bit_count() > 10 for k in kept):
                kept.append(h)
                want.add((g, name))
    frame = spark.createDataFrame(rows, "g string, id string, score int, hash bigint")
    for block in (7, 1000):
        assert {(x.g, x.id) for x in ranking.keep_first_near(frame, group="g", block=block).collect()} == want


def test_sequential_pairs_across_splits(spark):
    r = random.Random(5)
    rows = [(r.choice(("u", None)), r.choice("abc"), DAY + dt.timedelta(seconds=r.randrange(40_000)), i) for i in range(600)] + [("v", "a", None, 9999)]
    want = defaultdict(int)
    for session in ("u", None):
        mine = sorted((x for x in rows if x[0] == session and x[2]), key=lambda x: (x[2], x[3]))
        for p, q in zip(mine, mine[1:]):
            if (q[2] - p[2]).total_seconds() <= 30:
                want[p[1], q[1]] += 1
    events = spark.createDataFrame(rows, "session string, action string, at timestamp_ntz, event_id bigint")
    assert {(x.a, x.b): x.n for x in sequences.sequential_pairs(events).collect()} == dict(want)
    assert sequences.sequential_pairs(events.limit(0)).count() == 0


def test_latest_before(spark):
    left = spark.createDataFrame([("g", DAY + dt.timedelta(days=d), f"l{d}") for d in (0, 1, 5)], "g string, at timestamp_ntz, k string")
    right = spark.createDataFrame([("g", DAY + dt.timedelta(days=d, hours=1), f"r{d}") for d in (0, 3)], "g string, at timestamp_ntz, k string")
    got = {r.k: r.right_key for r in sequences.latest_before(left, right, by="g", at="at", key="k").collect()}
    assert got == {"l0": None, "l1": "r0", "l5": "r3"}


def test_set_similarity_is_exact(spark):
    r = random.Random(2)
    sets = {f"s{i:02d}": {f"x{r.randrange(14)}" for _ in range(r.randrange(1, 9))} for i in range(60)}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v] + [("s00", None), (None, "x1")], "set_id string, item string")
    reps = {}
    for k in sorted(sets):
        reps.setdefault(frozenset(sets[k]), k)
    names = sorted(reps.values())
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(x.a, x.b) for x in clusters.set_similarity(rows, threshold=0.5).collect()} == want


def test_diff_and_merge(spark):
    a = spark.createDataFrame([("1", "t", "x"), ("2", "t", None)], "id string, type string, content string")
    b = spark.createDataFrame([("2", "t", None), ("1", "u", "x"), ("3", "t", "z")], "id string, type string, content string")
    assert {(r.id, r.change) for r in merging.diff(a, b, compare=["type", "content"]).collect()} == {("1", "modified"), ("3", "added")}


def test_supersede_over_days(spark):
    rows = spark.createDataFrame([(i, "s", "decision", DAY + dt.timedelta(hours=h)) for i, h in enumerate((0, 1, 60))], "doc_id int, source string, memory_type string, created_at timestamp_ntz")
    assert [(r.doc_id, r.superseded_by) for r in maintenance.supersede(rows).orderBy("doc_id").collect()] == [(0, 1), (1, 2), (2, None)]


def test_belief_updates_fold_all_evidence(spark):
    r = random.Random(3)
    claims = {"long": [r.choice((1, -1)) for _ in range(5000)], "held": [1] * 300 + [-1] * 60, "denied": [-1] * 250, "one": [-1], None: [1, 1, -1]}
    rows = [(c, i, s) for c, signs in claims.items() for i, s in enumerate(signs)]
    r.shuffle(rows)
    want = {}
    for c, signs in claims.items():
        x = 0.5
        for n, s in enumerate(signs):
            x = max(0.01, min(0.99, x + s * 0.3 * (1 - x if s > 0 else x) / (1 + 0.1 * n)))
        want[c] = (round(x, 5), len(signs))
    got = {x.claim: (round(x.confidence, 5), x.evidence) for x in maintenance.belief_updates(spark.createDataFrame(rows, "claim string, event_id bigint, sign int")).collect()}
    assert got == want


def test_normalise_and_weights(spark):
    e = edges(spark, [("a", str(i), "r", 1.0) for i in range(10)])
    assert {r.weight for r in maintenance.normalise_outgoing(e).collect()} == {0.5}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    arr = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert get(S.cosine(arr(1, 0), arr(0, 0))) == 0.0
    assert get(S.cosine(arr(1, 0), arr(1, 0, 0))) is None
    assert abs(get(S.cosine(arr(1, 2), arr(2, 4))) - 1) < 1e-12
    assert get(S.days_between(F.lit(None).cast("timestamp"), F.current_timestamp())) is None
    assert get(S.near_hash(F.lit(0), F.lit(0))) is False
    assert abs(get(S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - math.pi * S.EARTH_M / 180) < 1e-6
    assert get(S.grade(F.lit(75.0))) == "B"
    assert get(S.char_entropy(F.lit("abab"))) == 1.0


def test_text_functions(spark):
    rows = spark.createDataFrame([("We decided to stop because Alpha failed.",), ('{"a": 1}',), ("",), (None,), ("k: v\na: b",), ("x " * 50_000,)], "t string")
    got = rows.select(T.memory_type(F.col("t")).alias("m"), T.structure(F.col("t")).alias("s"), T.keywords(F.col("t")).alias("k"), T.simhash(F.col("t")).alias("h"), T.essence(F.col("t")).alias("e")).collect()
    assert [r.m for r in got][:1] == ["decision"]
    assert [r.s for r in got] == ["prose", "json", "empty", "empty", "key_value", "prose"]
    assert got[2].h == got[3].h == 0


def test_bm25_and_suggest(spark):
    n = spark.createDataFrame([("a", "orphan synapses of the long graph run"), ("b", "the quick brown fox jumps over it"), ("c", None), ("d", "")], "id string, content string")
    q = spark.createDataFrame([(1, "orphan synapses"), (2, "nothing like it here"), (3, None)], "query_id int, query string")
    assert [(r.query_id, r.id) for r in scans.bm25(n, q).collect()] == [(1, "a")]
    assert scans.bm25(n.limit(0), q).count() == 0


def test_encode_steps_on_odd_texts(spark):
    docs = spark.createDataFrame([(1, "Met with Alpha and then Beta about caches.", DAY, None), (2, None, DAY, "fact"), (3, "  ", None, None), (4, "Saw Alpha again with Beta.", None, "fact")], "doc_id int, text string, created_at timestamp_ntz, memory_type string")
    out = encode.encode(docs)
    assert {(r.a, r.b, r.n) for r in out["entity_pairs"].collect()} == {("alpha", "beta", 2)}
    assert {r.doc_id for r in out["fibers"].collect()} == {1, 4}


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n" + "word " * 30 + "\n\n# Two\nshort\n")
    (tmp_path / "x.jsonl").write_text('{"id": "1", "memory": "hi", "created_at": "2025-01-01 00:00:00"}\nbroken\n')
    files = readers.read_text_files(spark, str(tmp_path))
    assert [(r.heading, r.words) for r in readers.chunk_markdown(files).collect()] == [("One", 30)]
    assert [(r.id, r.text) for r in readers.read_export(spark, str(tmp_path / "x.jsonl"), "memories").collect()] == [("1", "hi")]
    page = spark.createDataFrame([("<h2>T</h2><script>x</script><p>a &amp; b</p>",), (None,)], "h string").select(readers.html_to_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in page] == ["## T\n\na & b", None]


def test_stats_on_empty_tables(spark):
    co = spark.createDataFrame([], "id string, neuron_a string, neuron_b string, binding_strength double, created_at timestamp_ntz")
    assert stats.co_activation_counts(co).count() == 0
    assert stats.tag_cooccurrence(spark.createDataFrame([], "fiber_id string, tag string")).count() == 0
