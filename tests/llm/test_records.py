"""p3, p4, p5 on small and odd rows."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np

from engramlake.llm import cooccurrence, pii, pii_table, splitting

DAY = dt.datetime(2025, 1, 1)
FILES = "file_id bigint, config_id bigint, body string, created_at timestamp_ntz, max_words int"
CONFIGS = "config_id bigint, max_chunk_words int, min_chunk_words int, overlap_words int"


def test_sections():
    parts = lambda t: [t[a:b] for a, b in splitting.sections(t)]
    assert parts("") == [""]
    assert parts("---\nk: v\n# no\n---\nx\n# H\ny") == ["x\n", "y"]
    assert parts("---\nnever closed\n# H\ny") == ["---\nnever closed\n", "y"]
    assert parts("a\r\n## H\r\nb\r\n") == ["a\r\n", "b\r\n"]
    assert parts("```\n# code\n```\n#no\n####### no\n# \n# yes\nz") == ["```\n# code\n```\n#no\n####### no\n# \n", "z"]


def test_cuts_are_the_cheapest():
    r = random.Random(1)
    for _ in range(120):
        n, most = r.randrange(2, 26), r.randrange(2, 9)
        overlap, least = r.randrange(0, most), r.randrange(0, 5)
        p = np.array([r.choice((0.0, 1.0, 4.0, 8.0)) for _ in range(n - 1)])
        cuts = splitting.best_cuts(p, most, overlap, least)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(0 < b - a <= most for a, b in cuts)
        if n <= most:
            assert cuts == [(0, n)]
            continue
        assert all(q[0] == x[1] - overlap for x, q in zip(cuts, cuts[1:]))
        even_pieces = -(-(n - overlap) // (most - overlap))
        even = (n + (even_pieces - 1) * overlap) / even_pieces
        price = lambda size: splitting.PIECE + splitting.UNEVEN * ((size - even) / most) ** 2 + splitting.TOO_SHORT * (size < least)  # noqa: E731, B023
        cost = {0: 0.0}
        for e in range(1, n + 1):
            options = [price(e)] if e <= most else []
            options += [cost[q] + price(e - q + overlap) for q in range(max(overlap, 1), e) if e - q + overlap <= most and q in cost]
            if options:
                cost[e] = min(options) + (p[e - 1] if e < n else 0)
        mine = sum(price(b - a) for a, b in cuts) + sum(p[b - 1] for _, b in cuts[:-1])
        assert abs(mine - cost[n]) < 1e-6


def test_pieces_of_files(spark):
    wall = " ".join(f"w{i}" for i in range(1003))
    files = [(1, 1, "# H\n" + wall, DAY, 0), (1, 1, "# H\n" + wall, DAY, 0), (2, 9, wall, DAY, 0), (3, None, wall, DAY, 0), (4, 1, None, DAY, 0), (5, 1, "", DAY, 0), (6, 2, wall, None, 0), (None, 1, wall, DAY, 0), (7, 3, wall, DAY, 0)]
    configs = [(1, 100, 20, 10), (2, 100, None, None), (3, None, 1, 1), (None, 5, 1, 1)]
    rows = splitting.split_sections(spark.createDataFrame(files, FILES), spark.createDataFrame(configs, CONFIGS)).collect()
    assert {(r.file_id, r.section_no) for r in rows} == {(1, 1), (6, 0)}
    one = sorted((r for r in rows if r.file_id == 1), key=lambda r: r.piece_no)
    assert all(20 <= r.n_words <= 100 for r in one)
    back = one[0].text.split()
    for r in one[1:]:
        assert back[-10:] == r.text.split()[:10]
        back += r.text.split()[10:]
    assert " ".join(back) == wall
    assert splitting.split_sections(spark.createDataFrame([], FILES), spark.createDataFrame(configs, CONFIGS)).count() == 0


def brute(records, least, lift):
    sets = [s for s in records if len(s) > 1]
    n, single, both = len(sets), Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    return {p: c for p, c in both.items() if c >= least and c * n >= lift * single[p[0]] * single[p[1]]}


def test_cooccurrence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 3)  # so that baskets are cut into blocks
    r = random.Random(2)
    records = [{"hub"} | {f"i{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(0, 9))} for _ in range(300)]
    rows = [(f"r{i}", [*s, *list(s)[:2], None]) for i, s in enumerate(records)] + [("r0", list(records[0])), ("e", []), ("n", None), (None, ["a", "b"]), ("one", ["a", "a"])]
    got = cooccurrence.cooccurrence(cooccurrence.baskets(spark.createDataFrame(rows, "record string, items array<string>")), min_count=4, min_lift=1.5).collect()
    assert {(x.item_a, x.item_b): x.n_ab for x in got} == brute(records, 4, 1.5)


def test_memory_baskets(spark):
    co = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x"), ("b", "x", None), ("c", "x", "x"), (None, "x", "y")], "id string, neuron_a string, neuron_b string")
    fib = spark.createDataFrame([("a", ["x", "z", None, "x"]), ("d", None), ("e", [])], "id string, neuron_ids array<string>")
    assert {(r.record, tuple(r["items"])) for r in cooccurrence.memory_baskets(co, fib).collect()} == {("c:a", ("x", "y")), ("f:a", ("x", "z"))}
    assert cooccurrence.cooccurrence(cooccurrence.memory_baskets(co.limit(0), fib.limit(0))).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    chain = r.standard_normal((3, 3)).astype(np.float32)
    scores = [r.standard_normal((n, 3)).astype(np.float32) for n in (1, 4, 6)]
    for s, path in zip(scores, pii.viterbi(scores, chain)):
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(chain[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert abs(value(path) - max(value(p) for p in itertools.product(range(3), repeat=len(s)))) < 1e-4


def test_held_out_accuracy():
    tagger = pii.default_tagger()
    held = pii_table.labelled_table(500, seed=77)
    right = found = there = 0
    for (_, spans), got in zip(held, tagger.spans([t for t, _ in held])):
        want, have = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in got}
        right, found, there = right + len(want & have), found + len(have), there + len(want)
    assert right / found >= 0.95 and right / there >= 0.93


def test_redaction(spark):
    text = "Contact for the Zorvan outage: anna.lurdquist@melbor.example or +1-555-212-0142."
    rows = [("a", text), ("a", text), ("b", None), ("c", ""), ("d", " "), (None, text), ("e", "SSN masking covers 12 of 40 rows. " * 3000), ("f", "Release Nora ships with Tanquix.")]
    df = spark.createDataFrame(rows, "id string, content string")
    out = {(r.id, r.redacted) for r in pii.tag_personal(df).where("length(redacted) < 200").collect()}
    assert out == {("a", "Contact for the Zorvan outage: [EMAIL] or [PHONE]."), (None, "Contact for the Zorvan outage: [EMAIL] or [PHONE]."), ("c", ""), ("d", " "), ("f", "Release Nora ships with Tanquix.")}
    assert {(r.neuron_id, r.kind) for r in pii.personal_kinds(df).collect()} == {("a", "email"), ("a", "phone")}
    assert pii.personal_kinds(df.limit(0)).count() == 0
