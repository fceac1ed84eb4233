"""Maintenance passes: decay, reinforcement, inference, pruning, lifecycle.

A pass returns the changed rows; the caller writes a new version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.operators.graph import directed, spread
from engramlake.operators.scans import top
from engramlake.runtime import cut


def _now(now) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def decay_states(states: DataFrame, *, now, rate: float = 0.1, floor: float = 0.01) -> DataFrame:
    """Levels decayed by days since the last use (none within a day); below the floor they are 0."""
    days = F.coalesce(S.days_between(_now(now), F.col("last_activated")), F.lit(0.0))
    level = F.when(days < 1, F.col("activation_level")).otherwise(S.node_decay(F.col("activation_level"), F.lit(rate), days))
    return states.select("neuron_id", F.round(F.when(level < floor, 0.0).otherwise(level), 9).alias("activation_level"))


def decay_edges(synapses: DataFrame, *, now) -> DataFrame:
    """Sigmoid forgetting of weights by hours since the last use."""
    hours = S.days_between(_now(now), F.coalesce("last_activated", "created_at")) * 24
    return synapses.select("id", F.round(S.edge_time_decay(F.col("weight"), F.coalesce(hours, F.lit(0.0)), F.coalesce("reinforced_count", F.lit(0))), 9).alias("weight"))


def prune_candidates(synapses: DataFrame, neurons: DataFrame, fibers: DataFrame, *, now, least: float = 0.1, decayed: float = 0.05, grace_days: float = 7) -> DataFrame:
    """Weak, decayed, idle edges that no fiber holds, that end at no pinned or salient anchor, and are not a node's only way out."""
    idle = S.days_between(_now(now), F.coalesce("last_activated", "created_at"))
    faded = S.edge_time_decay(F.col("weight"), idle * 24, F.coalesce("reinforced_count", F.lit(0)))
    weak = synapses.where((F.col("weight") < least) & (faded < decayed) & (idle >= grace_days))
    held = fibers.select(F.explode("synapse_ids").alias("id")).where("id IS NOT NULL").distinct()
    safe = fibers.where(F.coalesce("pinned", F.lit(False)) | (F.col("salience") > 0.8)).select(F.col("anchor_neuron_id").alias("n")).where("n IS NOT NULL").distinct()
    ways = synapses.where("weight >= 0.02").groupBy("source_id").agg(F.count("*").alias("ways"))
    out = weak.join(held, "id", "left_anti").join(safe.select(F.col("n").alias("source_id")), "source_id", "left_anti").join(safe.select(F.col("n").alias("target_id")), "target_id", "left_anti")
    return out.join(ways, "source_id", "left").where((F.col("weight") < 0.02) | (F.col("ways") > 1)).select("id", "source_id", "target_id", "weight")


def boost_frequent(synapses: DataFrame, fibers: DataFrame, *, least: int = 5, delta: float = 0.03, k: int = 100) -> DataFrame:
    """Edges of the ``k`` most frequent fibers, each raised once."""
    busy = fibers.where(F.col("frequency") >= least).orderBy(F.desc("frequency"), "id").limit(k)
    edges = busy.select(F.explode("synapse_ids").alias("id")).distinct()
    return synapses.join(edges, "id", "left_semi").select("id", F.round(F.least(F.lit(1.0), F.col("weight") + delta), 9).alias("weight"))


def normalise_outgoing(synapses: DataFrame, *, budget: float = 5.0) -> DataFrame:
    """Outgoing weights of a node scaled down to the budget; sums combine map-side, so a hub is no single task."""
    total = synapses.groupBy("source_id").agg(F.sum("weight").alias("t")).where(F.col("t") > budget)
    return synapses.join(total, "source_id").select("id", F.round(F.col("weight") * budget / F.col("t"), 9).alias("weight"))


def infer_edges(counts: DataFrame, synapses: DataFrame, *, least: int = 3, k: int = 50) -> DataFrame:
    """``(a, b, action, weight)``: often co-active pairs, new or to reinforce, ``k`` of each.

    ``counts(a, b, n, strength)``.
    """
    there = synapses.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().withColumn("there", F.lit(True))
    rows = counts.where(F.col("n") >= least).join(there, ["a", "b"], "left")
    action = F.when(F.col("there"), "reinforce").otherwise("create")
    weight = F.round(S.inferred_weight(F.col("n"), F.coalesce("strength", F.lit(0.5))), 9)
    return top(rows.select("a", "b", "n", action.alias("action"), weight.alias("weight")), ["action"], [F.desc("n"), "a", "b"], k).drop("rank")


def replay_salient(synapses: DataFrame, fibers: DataFrame, members: DataFrame, *, k: int = 20, up: float = 1.1, down: float = 0.98) -> DataFrame:
    """Edges inside the ``k`` most salient fibers strengthened, edges across their border weakened, once a fiber."""
    best = fibers.orderBy(F.desc("salience"), "id").limit(k).select(F.col("id").alias("fiber_id"))
    m = members.join(F.broadcast(best), "fiber_id", "left_semi")
    src = m.select("fiber_id", F.col("neuron_id").alias("source_id"))
    dst = m.select("fiber_id", F.col("neuron_id").alias("target_id"))
    out = synapses.select("id", "source_id", "target_id", "weight")
    a = out.join(src, "source_id").select("id", "fiber_id", "weight")
    b = out.join(dst, "target_id").select("id", "fiber_id", "weight")
    touched = a.unionByName(b).groupBy("id", "fiber_id").agg(F.count("*").alias("ends"), F.first("weight").alias("weight"))
    both = touched.groupBy("id").agg(F.count_if(F.col("ends") == 2).alias("inside"), F.count_if(F.col("ends") == 1).alias("border"), F.first("weight").alias("weight"))
    return both.select("id", F.round(F.least(F.lit(1.0), F.col("weight") * F.pow(F.lit(up), F.col("inside")) * F.pow(F.lit(down), F.col("border"))), 9).alias("weight"))


def dream(synapses: DataFrame, neurons: DataFrame, *, seeds: int = 5, hops: int = 2, k: int = 200, threshold: float = 0.2) -> DataFrame:
    """Weak links between nodes that the same seed activates; seeds are those with the smallest hashes."""
    start = neurons.orderBy(F.md5("id"), "id").limit(seeds).select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(1.0).alias("level"))
    lit = top(spread(directed(synapses), start, max_hops=hops, threshold=threshold).where("node <> query_id"), ["query_id"], [F.desc("level"), "node"], 100).select("query_id", "node")
    pair = lit.join(lit.withColumnRenamed("node", "other"), "query_id").where("node < other").select("node", "other").distinct()  # at most 100 nodes a seed
    there = synapses.select(F.least("source_id", "target_id").alias("node"), F.greatest("source_id", "target_id").alias("other"))
    return pair.join(there, ["node", "other"], "left_anti").orderBy("node", "other").limit(k).withColumn("weight", F.lit(0.1))


def lifecycle(neurons: DataFrame, states: DataFrame, *, now) -> DataFrame:
    """Heat and state of every neuron by idle days, uses and priority."""
    rows = neurons.join(states, F.col("id") == F.col("neuron_id"), "left")
    days = S.days_between(_now(now), F.coalesce("last_activated", "created_at"))
    heat = S.heat_score(days, F.coalesce("access_frequency", F.lit(0)), F.coalesce("metadata.priority", F.lit(5)))
    return rows.select("id", F.round(heat, 6).alias("heat"), S.lifecycle_state(days, heat).alias("state"))


def compression_tier(fibers: DataFrame, *, now) -> DataFrame:
    """Tier 0-4 by age; pinned fibers stay whole."""
    d = S.days_between(_now(now), F.col("created_at"))
    tier = F.when(F.coalesce("pinned", F.lit(False)) | (d < 7), 0).when(d < 30, 1).when(d < 90, 2).when(d < 180, 3).otherwise(4)
    return fibers.select("id", tier.alias("tier"))


def tier_moves(fibers: DataFrame, *, now, cap: int = 100) -> DataFrame:
    """``(id, move)``: frequent fibers become hot (at most ``cap`` a brain), idle ones cool; pinned ones stay."""
    idle = S.days_between(_now(now), F.coalesce("last_conducted", "created_at"))
    move = F.when((F.col("frequency") >= 5) & (idle < 30), "hot").when(idle >= 90, "cold").when(idle >= 30, "warm")
    rows = fibers.where(~F.coalesce("pinned", F.lit(False))).select("id", "brain_id", "frequency", move.alias("move")).where("move IS NOT NULL")
    hot = top(rows.where("move = 'hot'"), ["brain_id"], [F.desc("frequency"), "id"], cap)
    return rows.where("move <> 'hot'").select("id", "move").unionByName(hot.select("id", "move"))


def supersede(memories: DataFrame) -> DataFrame:
    """``(doc_id, valid_from, valid_until, superseded_by)``: each memory ends where the next of its source and type starts."""
    rows = memories.where("created_at IS NOT NULL").select("source", "memory_type", "doc_id", F.col("created_at").alias("valid_from"), F.to_date("created_at").alias("day"))
    # A source of any size is split into days; what follows a day is the first row of the next day that has any.
    at = F.struct(F.col("valid_from").alias("t"), F.col("doc_id").alias("d"))
    inside = rows.withColumn("next", F.lead(at).over(Window.partitionBy("source", "memory_type", "day").orderBy("valid_from", "doc_id")))
    days = rows.groupBy("source", "memory_type", "day").agg(F.min(at).alias("first"))
    days = days.select("source", "memory_type", "day", F.lead("first").over(Window.partitionBy("source", "memory_type").orderBy("day")).alias("then"))
    same = F.col("i.source").eqNullSafe(F.col("d.source")) & F.col("i.memory_type").eqNullSafe(F.col("d.memory_type")) & (F.col("i.day") == F.col("d.day"))
    both = inside.alias("i").join(days.alias("d"), same).select("i.doc_id", "i.valid_from", F.coalesce("i.next", "d.then").alias("n"))
    return both.select("doc_id", "valid_from", F.col("n.t").alias("valid_until"), F.col("n.d").alias("superseded_by"))


#: Maps of the confidence that one step of a fold composes.
FOLD = 4096


def _composed(maps: Column) -> Column:
    """The maps ``x -> clamp(a x + b, lo, hi)`` in an array of ``m``, applied in order, as one such map."""
    nothing = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def then(s: Column, x: Column) -> Column:
        m = x["m"]
        end = lambda v: F.greatest(m["lo"], F.least(m["hi"], m["a"] * v + m["b"]))
        return F.struct((s["a"] * m["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b"), end(s["lo"]).alias("lo"), end(s["hi"]).alias("hi"))

    return F.aggregate(maps, nothing, then)


def belief_updates(events: DataFrame) -> DataFrame:
    """Confidence after all of a claim's evidence in order of time.

    A piece maps the confidence ``x`` to ``clamp(a x + b)`` with ``a > 0``, and such maps
    compose to one of their form.  Pieces are numbered by ranges of their order and then
    composed ``FOLD`` at a time, so no step gathers the pieces of a claim.
    """
    order = ["event_id", "sign"]
    rows = cut(events.select("claim", *order).repartitionByRange("claim", *order).withColumn("block", F.spark_partition_id()))
    counts = rows.groupBy("claim", "block").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("claim").orderBy("block")) - F.col("k")
    starts = counts.select("claim", "block", before.alias("start"))
    inside = rows.withColumn("r", F.row_number().over(Window.partitionBy("claim", "block").orderBy(*order)) - 1)
    same = F.col("i.claim").eqNullSafe(F.col("s.claim")) & (F.col("i.block") == F.col("s.block"))
    placed = inside.alias("i").join(starts.alias("s"), same).select("i.claim", "i.sign", (F.col("start") + F.col("r")).alias("n"))
    maps = placed.select("claim", "n", F.lit(1).cast("bigint").alias("k"), S.hypothesis_map(F.col("n"), F.lit(1.0), F.col("sign")).alias("m"))
    for _ in range(2):
        block = F.floor(F.col("n") / FOLD)
        maps = maps.groupBy("claim", block.alias("n")).agg(F.sum("k").alias("k"), _composed(F.array_sort(F.collect_list(F.struct("n", "m")))).alias("m"))
    last = maps.groupBy("claim").agg(F.sum("k").alias("k"), _composed(F.array_sort(F.collect_list(F.struct("n", "m")))).alias("m"))
    confidence = F.greatest(F.col("m.lo"), F.least(F.col("m.hi"), F.col("m.a") * 0.5 + F.col("m.b")))
    return last.select("claim", F.round(confidence, 6).alias("confidence"), F.col("k").alias("evidence"))