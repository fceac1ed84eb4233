import json
import random

import pytest

from engramlake.operators import changelog as L

SCHEMA = "receipt_id string, change string, sequence bigint, operation string, extra string"


def row(receipt, seq, op, entity="e", kind="synapse", payload=None, cut=None):
    change = json.dumps({"entity_type": kind, "entity_id": entity, "operation": op, "sequence": seq, "payload": payload or {}, "device_id": "d"})
    return (receipt, change[:cut], seq, None, "x")


def state(spark, rows, **options):
    return {(r.entity_type, r.entity_id): r.receipt_id for r in L.replay(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def plain(rows):
    best = {}
    for receipt, change, *_ in rows:
        try:
            x = json.loads(change)
        except ValueError:
            continue
        if receipt not in best or x["sequence"] < best[receipt]["sequence"]:
            best[receipt] = x
    there = {}
    for receipt, x in sorted(best.items(), key=lambda p: (p[1]["sequence"], p[0])):
        key, op = (x["entity_type"], x["entity_id"]), x["operation"].strip().lower()
        if op == "insert" or (op == "update" and key in there):
            there[key] = receipt
        elif op == "delete":
            there.pop(key, None)
    return there


def test_replay_equals_a_sequential_one(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        op = r.choice(("insert", " Update", "DELETE ", "update"))
        seq, entity = i * r.choice((1, 2)), f"e{r.randrange(12) if r.random() < 0.7 else 0}"
        for _ in range(r.choice((1, 1, 3))):
            rows.append(row(f"r{i}", seq + r.choice((0, 0, 1000)), op, entity, cut=r.choice((None, None, 30))))
    r.shuffle(rows)
    assert state(spark, rows) == plain(rows)


def test_edges(spark):
    assert state(spark, []) == {}
    assert state(spark, [("r", None, 1, "insert", ""), (None, row("r", 1, "insert")[1], 1, "", ""), ("r", "[1]", 1, "", ""), ("r", '"x"', 1, "", "")]) == {}
    assert state(spark, [row("a", 1, "update"), row("b", 2, "delete")]) == {}
    assert state(spark, [row("a", 1, "insert"), row("b", 2, "merge")]) == {("synapse", "e"): "a"}  # unknown operations do nothing
    assert state(spark, [row("b", 1, "insert"), row("a", 1, "insert")]) == {("synapse", "e"): "b"}  # a tie goes by receipt
    with pytest.raises(ValueError):
        state(spark, [], gaps="maybe")


def test_gaps_hold_what_follows(spark):
    rows = [row("a", 5, "insert"), row("b", 6, "update"), row("c", 8, "delete")]
    assert state(spark, rows) == {}
    assert state(spark, rows, gaps="hold") == {("synapse", "e"): "b"}
    assert state(spark, rows, through=5) == {("synapse", "e"): "a"}


@pytest.mark.parametrize("seqs, mark", [([], None), ([3], 3), ([1, 2, 3], 3), ([1, 2, 4], 2), (list(range(70_000)), 69_999), ([*range(65_536), 65_537], 65_535), ([0, 140_000], 0), ([*range(65_536), *range(140_000, 140_010)], 65_535)])
def test_watermark(spark, seqs, mark):
    rows = spark.createDataFrame([(s,) for s in seqs], "sequence bigint")
    assert L.committed_watermark(rows).first().watermark == mark


def test_fields(spark):
    rows = [row("a", 1, "insert", payload={"w": 1, "t": "x"}), row("b", 2, "delete"), row("c", 3, "insert", payload={"w": 2}), row("d", 4, "update", payload={"k": "y"}), row("e", 5, "update", payload={"k": "z"})]
    got = {r.field: r.value for r in L.replay_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"w": "2", "k": "z"}
