"""Traversal of the edge table: expansion, paths, activation, components, topology.

Loops run over frontiers of (query, node) rows, so many queries go in one job.  Lineage is
cut with a written checkpoint each round, and only scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.runtime import cut


def directed(synapses: DataFrame, *, both: bool = True, types: Sequence[str] | None = None, least_weight: float | None = None) -> DataFrame:
    """``(src, dst, weight, type, id)``; with ``both`` every edge is there in either direction."""
    rows = synapses.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    if types is not None:
        rows = rows.where(F.col("type").isin(list(types)))
    if least_weight is not None:
        rows = rows.where(F.col("weight") >= least_weight)
    out = rows.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "type", "id")
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "type", "id").where("src <> dst")) if both else out


def neighbours(synapses: DataFrame, ids: Sequence[str], *, direction: str = "both", types: Sequence[str] | None = None, least_weight: float | None = None) -> DataFrame:
    """``(neuron_id, neighbour_id, synapse_id, weight)``, one hop.

    ``in`` follows incoming edges only where the edge is bidirectional; ``both`` follows
    every incoming edge.
    """
    edges = directed(synapses, both=False, types=types, least_weight=least_weight)
    there = edges.select(F.col("src").alias("neuron_id"), F.col("dst").alias("neighbour_id"), F.col("id").alias("synapse_id"), "weight")
    rows = synapses.where(F.lower("direction").isin("bi", "bidirectional", "both")) if direction == "in" else synapses
    back = directed(rows, both=False, types=types, least_weight=least_weight).select(F.col("dst").alias("neuron_id"), F.col("src").alias("neighbour_id"), F.col("id").alias("synapse_id"), "weight")
    out = {"out": there, "in": back, "both": there.unionByName(back)}[direction]
    return out.where(F.col("neuron_id").isin(list(ids))).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, max_hops: int = 4) -> DataFrame:
    """``(source, target, hops, path)`` for reachable pairs; among the shortest paths the smallest by node ids.

    One path is kept for each (source, node), so the frontier is bounded by sources times nodes.
    """
    pairs = cut(pairs.distinct())
    links = cut(edges.select("src", "dst").distinct())
    frontier = pairs.select("source", F.col("source").alias("node"), F.array("source").alias("path")).distinct()
    seen = found = frontier
    for _ in range(max_hops):
        grown = frontier.join(links, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = grown.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        seen = cut(seen.select("source", "node", "path").unionByName(frontier))
        found = seen
    hit = found.join(pairs.withColumnRenamed("target", "node"), ["source", "node"])
    return hit.select("source", F.col("node").alias("target"), (F.size("path") - 1).alias("hops"), "path")


def spread(edges: DataFrame, anchors: DataFrame, *, decay: float = 0.5, threshold: float = 0.2, max_hops: int = 4, least_weight: float = 0.1, diminishing: bool = False, uses: DataFrame | None = None, resting: DataFrame | None = None) -> DataFrame:
    """Spreading activation, ``(query_id, node, level, hop)``: the best level over all walks.

    ``anchors(query_id, node, level)``.  A step multiplies by ``decay`` and the edge's
    weight; levels below the threshold end a walk.  Only labels better than those with
    fewer hops go on.  An unknown anchor activates itself alone.  With ``diminishing`` a
    query ends after its first hop once a hop reaches fewer than 2 nodes or less than 0.15
    of the hop before.  ``uses(node, frequency)`` lets often used nodes conduct up to 15 %
    better; nodes of ``resting(node)`` are not reached.
    """
    links = edges.where(F.col("weight") >= least_weight).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    if uses is not None:
        factor = 1 + F.least(F.lit(0.15), 0.05 * F.log1p(F.coalesce("frequency", F.lit(0))))
        links = links.join(uses.select(F.col("node").alias("dst"), "frequency"), "dst", "left").select("src", "dst", (F.col("weight") * factor).alias("weight"))
    if resting is not None:
        links = links.join(resting.select(F.col("node").alias("dst")), "dst", "left_anti")
    links = cut(links)
    best = cut(anchors.groupBy("query_id", "node").agg(F.max("level").alias("level")).withColumn("hop", F.lit(0)))
    frontier = best
    for hop in range(1, max_hops + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (F.col("level") * F.col("weight") * decay).alias("level"))
        step = step.where(F.col("level") >= threshold).groupBy("query_id", "node").agg(F.max("level").alias("level")).withColumn("hop", F.lit(hop))
        old = best.select("query_id", "node", F.col("level").alias("known"))
        frontier = cut(step.join(old, ["query_id", "node"], "left").where("known IS NULL OR level > known").drop("known"))
        if frontier.isEmpty():
            break
        if diminishing:
            reached = frontier.groupBy("query_id").agg(F.count("*").alias("now"))
            if hop > 1:
                go = reached.join(before, "query_id").where("now >= 2 AND now >= 0.15 * before").select("query_id")
                ahead = frontier.join(go, "query_id", "left_semi")
            else:
                ahead = frontier
            before = cut(reached.withColumnRenamed("now", "before"))
        both = best.unionByName(frontier)
        if diminishing:
            frontier = cut(ahead)
        best = cut(both.groupBy("query_id", "node").agg(F.max(F.struct("level", -F.col("hop"))).alias("_b")).select("query_id", "node", "_b.level", (-F.col("_b.col2")).alias("hop")))
    return best


def combine_sets(activations: DataFrame) -> DataFrame:
    """``(node, level, sets)`` from ``(query_id, node, level)``: nodes of several sets get half of each further level, capped at 1."""
    order = F.array_sort(F.collect_list(F.struct("query_id", "level")))  # one entry a set
    fold = F.aggregate(F.slice(order, 2, 1 << 20), order[0]["level"], lambda s, x: F.least(F.lit(1.0), s + 0.5 * x["level"]))
    return activations.groupBy("node").agg(F.round(fold, 9).alias("level"), F.count("*").alias("sets"))


def intersection(activations: DataFrame) -> DataFrame:
    """Nodes that more than one set reached, most sets and highest sum first."""
    return activations.groupBy("node").agg(F.countDistinct("query_id").alias("sets"), F.round(F.sum("level"), 9).alias("total")).where("sets > 1")


def induced(activations: DataFrame, synapses: DataFrame, *, least: float = 0.2, k: int = 50) -> DataFrame:
    """Edges among the ``k`` most active nodes."""
    nodes = cut(activations.where(F.col("level") >= least).groupBy("node").agg(F.max("level").alias("level")).orderBy(F.desc("level"), "node").limit(k).select("node"))
    return synapses.join(F.broadcast(nodes.select(F.col("node").alias("source_id"))), "source_id", "left_semi").join(F.broadcast(nodes.select(F.col("node").alias("target_id"))), "target_id", "left_semi")


def pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.15, rounds: int = 20, tolerance: float = 1e-6, least_weight: float = 0.1) -> DataFrame:
    """Personalised PageRank by pushing residuals, ``(node, rank)``, normalised to the largest.

    ``edges(src, dst, weight)`` are outgoing, ``seeds(node, level)``.  A node without
    outgoing edges returns its mass to the seeds.
    """
    links = edges.where(F.col("weight") >= least_weight).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("all"))
    links = cut(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")))
    total = seeds.agg(F.sum("level").alias("t")).first()["t"] or 1.0
    start = cut(seeds.groupBy("node").agg((F.sum("level") / total).alias("residual")))
    rank, residual = start.select("node", F.lit(0.0).alias("rank")), start
    sources = cut(links.select("src").distinct())
    for _ in range(rounds):
        rank = rank.unionByName(residual.select("node", (damping * F.col("residual")).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank"))
        pushed = residual.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), ((1 - damping) * F.col("residual") * F.col("share")).alias("residual"))
        stuck = residual.join(sources, F.col("node") == F.col("src"), "left_anti").agg(F.sum((1 - damping) * F.col("residual")).alias("s"))
        back = start.join(F.broadcast(stuck)).select("node", (F.col("residual") * F.coalesce("s", F.lit(0.0))).alias("residual"))  # stuck is one row
        residual = cut(pushed.unionByName(back).groupBy("node").agg(F.sum("residual").alias("residual")).where("residual > 0"))
        rank = cut(rank)
        if (residual.agg(F.sum("residual").alias("r")).first()["r"] or 0.0) < tolerance:
            break
    top = rank.agg(F.max("rank").alias("top"))
    return rank.join(F.broadcast(top)).select("node", (F.col("rank") / F.col("top")).alias("rank"))


def trail(fibers: DataFrame, anchors: Sequence[str], *, now, decay: float = 0.1, threshold: float = 0.2) -> DataFrame:
    """Activation along ordered pathways, ``(node, level)``.

    Each step from an anchor multiplies by ``(1 - decay)``, conductivity and recency;
    steps below the threshold end the walk; a node keeps its best level.
    """
    hours = (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("last_conducted").cast("timestamp"))) / 3_600e6
    factor = (1 - decay) * F.coalesce("conductivity", F.lit(1.0)) * S.time_factor(hours, F.coalesce("salience", F.lit(0.0)))
    steps = fibers.where(F.arrays_overlap("pathway", F.array(*map(F.lit, anchors)))).select("id", factor.alias("f"), "pathway")
    nodes = steps.select("id", "f", F.posexplode("pathway").alias("pos", "node"), F.filter(F.transform("pathway", lambda x, i: F.when(x.isin(list(anchors)), i)), lambda i: i.isNotNull()).alias("at"))
    gap = F.array_min(F.transform("at", lambda i: F.abs(F.col("pos") - i)))
    return nodes.select("node", F.pow("f", gap).alias("level")).where(f"level >= {threshold} AND node IS NOT NULL").groupBy("node").agg(F.round(F.max("level"), 9).alias("level"))


def hybrid(primary: DataFrame, secondary: DataFrame, *, damp: float = 0.6) -> DataFrame:
    """``(node, level)``: levels along pathways, gaps and lower levels filled by damped spreading."""
    second = secondary.groupBy("node").agg((F.max("level") * damp).alias("other"))
    both = primary.select("node", "level").join(second, "node", "full")
    return both.select("node", F.round(F.greatest(F.coalesce("level", F.lit(0.0)), F.coalesce("other", F.lit(0.0))), 9).alias("level"))


def expand_seeds(synapses: DataFrame, neurons: DataFrame, seeds: Sequence[str], *, k: int = 10, least_weight: float = 0.3) -> DataFrame:
    """Best outgoing neighbours of the seeds that are not of type time and no seeds themselves."""
    out = synapses.where(F.col("source_id").isin(list(seeds)) & (F.col("weight") >= least_weight) & ~F.col("target_id").isin(list(seeds)))
    best = out.groupBy("target_id").agg(F.max("weight").alias("weight"))
    kept = best.join(neurons.where("type <> 'time'").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return kept.orderBy(F.desc("weight"), "target_id").limit(k)


def chain(synapses: DataFrame, seed: str, types: Sequence[str], *, max_depth: int = 5, least_weight: float = 0.1) -> DataFrame:
    """Breadth-first chain over edges of some types, ``(node, depth, weight)``; a node is visited once.

    ``weight`` is the product of the weights on the best path of that depth.
    """
    links = cut(directed(synapses, both=False, types=types, least_weight=least_weight).select("src", "dst", "weight"))
    spark = synapses.sparkSession
    frontier = spark.createDataFrame([(seed, 1.0)], "node string, weight double")
    seen, out = frontier.select("node"), None
    for depth in range(1, max_depth + 1):
        grown = frontier.join(links.withColumnRenamed("weight", "w"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("weight") * F.col("w")).alias("weight"))
        frontier = cut(grown.join(seen, "node", "left_anti").groupBy("node").agg(F.max("weight").alias("weight")))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.select("node")))
        layer = frontier.withColumn("depth", F.lit(depth))
        out = layer if out is None else out.unionByName(layer)
    empty = spark.createDataFrame([], "node string, weight double, depth int")
    return (empty if out is None else out).select("node", "depth", F.round("weight", 9).alias("weight"))


def transitive_closures(synapses: DataFrame, kind: str, *, k: int = 50) -> DataFrame:
    """A to C where A to B and B to C are edges of the kind and A to C is not; weight is half the smaller."""
    e = synapses.where((F.col("type") == kind) & (F.col("source_id") != F.col("target_id"))).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    two = e.alias("x").join(e.alias("y"), F.col("x.target_id") == F.col("y.source_id")).where("x.source_id <> y.target_id")
    new = two.select(F.col("x.source_id").alias("source_id"), F.col("y.target_id").alias("target_id"), (0.5 * F.least("x.weight", "y.weight")).alias("weight"))
    new = new.groupBy("source_id", "target_id").agg(F.round(F.max("weight"), 9).alias("weight")).join(e.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    return new.orderBy(F.desc("weight"), "source_id", "target_id").limit(k)


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node id of each connected component.

    ``edges(src, dst)``.  Large-star and small-star steps alternate, so the number of
    rounds grows with the logarithm of the longest path; minima combine map-side, and no
    step gathers the neighbours of a node.  Self-loops count as edges of a lone node.
    """
    everything = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "node")
    star = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        star = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    label = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return everything.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """One row ``(triangles, wedges, clustering)``; edges point from lower to higher degree, so hubs start no wedges."""
    pair = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = cut(pair.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d")))
    rank = lambda c: degree.select(F.col("n").alias(c), F.col("d").alias(f"d_{c}"))
    placed = pair.join(rank("a"), "a").join(rank("b"), "b")
    low = F.struct("d_a", "a") < F.struct("d_b", "b")
    up = cut(placed.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = up.alias("p").join(up.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = wedge.join(pair, ["a", "b"]).agg(F.count("*").alias("triangles"))
    wedges = degree.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("wedges"))
    return closed.join(F.broadcast(wedges)).select("triangles", "wedges", F.round(F.when(F.col("wedges") == 0, 0.0).otherwise(3 * F.col("triangles") / F.col("wedges")), 9).alias("clustering"))


def gromov_delta(edges: DataFrame, *, sample: int = 24, max_hops: int = 15) -> DataFrame:
    """One row ``(delta, normalised, structure)``: four-point hyperbolicity over a sample of nodes.

    The sample is the ``sample`` nodes with the smallest hashes; only their distances to
    each other, ``sample`` squared numbers, reach one task.
    """
    nodes = cut(edges.select(F.col("src").alias("node")).distinct().orderBy(F.xxhash64("node"), "node").limit(sample))
    pairs = nodes.select(F.col("node").alias("source")).join(nodes.select(F.col("node").alias("target")), F.col("source") < F.col("target"))  # sample squared
    far = shortest_paths(edges, pairs, max_hops=max_hops).select("source", "target", "hops")

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        from itertools import combinations

        d = {(a, b): h for a, b, h in frame.itertuples(index=False)}
        names = sorted({x for p in d for x in p})
        get = lambda a, b: d.get((min(a, b), max(a, b)))
        worst, widest = 0.0, max(d.values(), default=1)
        for w, x, y, z in combinations(names, 4):
            six = [get(w, x), get(y, z), get(w, y), get(x, z), get(w, z), get(x, y)]
            if None not in six:
                sums = sorted((six[0] + six[1], six[2] + six[3], six[4] + six[5]))
                worst = max(worst, (sums[2] - sums[1]) / 2)
        return pd.DataFrame({"delta": [worst], "normalised": [worst / widest]})

    out = far.groupBy(F.lit(1).alias("g")).applyInPandas(measure, "delta double, normalised double")
    return out.withColumn("structure", S.structure_label(F.col("normalised")))


def degrees(synapses: DataFrame) -> DataFrame:
    return synapses.select(F.explode(F.array("source_id", "target_id")).alias("neuron_id")).groupBy("neuron_id").agg(F.count("*").alias("degree"))


def top_share(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """Share of the ``k`` largest values of each group in its sum."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value)))
    return rows.withColumn("_r", rank).groupBy(group).agg((F.sum(F.when(F.col("_r") <= k, F.col(value))) / F.sum(value)).alias("share"))
