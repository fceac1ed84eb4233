"""Fusion, ranking, sufficiency and token budgets.

Everything works on rows tagged with a ``query_id``, so one job ranks many queries.  A query
may have any number of rows: folds over ordered rows (greedy budgets, keep-first
deduplication) run on the few rows that can matter, or block by block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.operators.scans import top
from engramlake.runtime import cut

#: Weight of each retriever in the fusion. Fixed values.
RETRIEVERS = {"time": 1.0, "entity": 0.9, "keyword": 0.7, "embedding": 1.0, "graph": 0.5, "fuzzy": 0.4}


def retriever_weight(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RETRIEVERS.items() for x in kv]), name), F.lit(1.0))


def fuse(ranked: DataFrame, *, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``(query_id, retriever, neuron_id, rank)``."""
    return ranked.groupBy("query_id", "neuron_id").agg(F.round(F.sum(retriever_weight(F.col("retriever")) / (k + F.col("rank"))), 9).alias("score"))


def to_levels(fused: DataFrame, *, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """Scores of each query scaled to ``[low, high]``; equal scores all become ``high``."""
    ends = fused.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    level = F.when(F.col("hi") - F.col("lo") < 1e-12, high).otherwise(low + (high - low) * (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return fused.join(ends, "query_id").select("query_id", "neuron_id", F.round(level, 9).alias("level"))


def inhibit(activations: DataFrame, *, k: int = 10, damp: float = 0.3, threshold: float = 0.2) -> DataFrame:
    """Lateral inhibition: each source's share of ``k`` winners, the rest of ``k`` by level; losers are damped.

    ``activations(query_id, node, level, source)``.
    """
    activations = activations.where("query_id IS NOT NULL")
    sources = activations.groupBy("query_id").agg(F.countDistinct("source").alias("n"))
    # every winner is among the first k of its source
    best = top(activations, ["query_id", "source"], [F.desc("level"), "node"], k).withColumnRenamed("rank", "r")
    ranked = best.join(sources, "query_id").withColumn("first", F.col("r") <= F.ceil(F.lit(k) / F.col("n")))
    winners = top(ranked, ["query_id"], [F.desc("first"), F.desc("level"), "node"], k).select("query_id", "node", "source")
    same = (F.col("a.query_id") == F.col("w.query_id")) & (F.col("a.node") == F.col("w.node")) & F.col("a.source").eqNullSafe(F.col("w.source"))
    level = F.when(F.col("w.node").isNotNull(), F.col("a.level")).otherwise(F.col("a.level") * damp)
    placed = activations.alias("a").join(winners.alias("w"), same, "left")
    return placed.select("a.query_id", "a.node", F.round(level, 9).alias("level"), "a.source").where(F.col("level") >= threshold)


def stabilise(activations: DataFrame, *, rounds: int = 10) -> DataFrame:
    """Noise floor, damping and homeostatic scaling of each query's levels until they settle.

    A round is one factor for a whole query, so the state is a list of factors; each round
    is an aggregate over the distinct levels.
    """
    step = lambda x, scale: F.when(x < 0.05, 0.0).otherwise(F.least(F.lit(1.0), x * 0.85 * scale))
    settled = lambda scales: F.aggregate(scales, F.col("level"), step)
    grid = cut(activations.groupBy("query_id", F.col("level").cast("double").alias("level")).agg(F.count("*").alias("k")))
    state = grid.select("query_id").distinct().select("query_id", F.array().cast("array<double>").alias("scales"), F.lit(False).alias("done"))
    same = F.col("g.query_id").eqNullSafe(F.col("s.query_id"))
    for n in range(rounds):
        now = grid.alias("g").join(state.where("NOT done").alias("s"), same).select("g.query_id", "level", "k", "scales")
        now = now.withColumn("x", settled(F.col("scales")))
        moved = F.abs(F.col("x") - settled(F.slice("scales", 1, n - 1))) if n > 1 else F.abs(F.col("x") - F.col("level")) if n else F.lit(1.0)
        live = F.when(F.col("x") >= 0.05, F.col("k"))
        sums = now.groupBy("query_id", "scales").agg(F.max(moved).alias("moved"), F.sum(live).alias("live"), F.sum(live * F.col("x") * 0.85).alias("mass"))
        scale = F.when(F.col("live").isNull(), 1.0).otherwise(F.least(F.lit(3.0), 1 + 0.3 * (0.5 * F.col("live") / F.col("mass") - 1)))
        still = F.col("moved") < 0.01
        new = sums.select("query_id", F.when(still, F.col("scales")).otherwise(F.concat("scales", F.array(scale))).alias("scales"), (still | F.col("live").isNull()).alias("done"))
        state = cut(state.where("done").unionByName(new))
        if state.where("NOT done").isEmpty():
            break
    rows = activations.select("query_id", "node", F.col("level").cast("double").alias("level")).alias("g").join(state.alias("s"), same)
    return rows.select("g.query_id", "node", F.round(settled(F.col("scales")), 9).alias("level")).where("level > 0")


def deprioritise(activations: DataFrame, neurons: DataFrame, *, threshold: float = 0.05) -> DataFrame:
    """Disputed nodes at half, superseded ones at a quarter of their level."""
    marks = neurons.select(F.col("id").alias("node"), F.col("metadata.disputed").alias("disputed"), F.col("metadata.superseded").alias("superseded"))
    factor = F.when(F.coalesce("superseded", F.lit(False)), 0.25).when(F.coalesce("disputed", F.lit(False)), 0.5).otherwise(1.0)
    return activations.join(marks, "node", "left").select("query_id", "node", F.round(F.col("level") * factor, 9).alias("level")).where(F.col("level") >= threshold)


def sufficiency(activations: DataFrame) -> DataFrame:
    """One row a query: size, entropy in bits, share of the top three, confidence, verdict."""
    total = activations.groupBy("query_id").agg(F.sum("level").alias("mass"), F.max("level").alias("top"), F.count("*").alias("nodes"), F.sum(F.col("level") * F.log2("level")).alias("bits"))
    three = top(activations, ["query_id"], [F.desc("level"), "node"], 3).groupBy("query_id").agg(F.sum("level").alias("three"))
    # -sum(p log2 p) with p = level / mass
    entropy = F.log2("mass") - F.col("bits") / F.col("mass")
    out = total.join(three, "query_id").select("query_id", "nodes", "top", entropy.alias("entropy"), (F.col("three") / F.col("mass")).alias("focus"))
    confidence = S.clamp(0.30 * F.col("top") + 0.20 * F.col("focus") + 0.15, 0.0, 1.0)
    verdict = F.when(F.col("nodes") == 0, "no_anchors").when((F.col("entropy") >= 3.0) & (F.col("focus") < 0.2), "ambiguous").when(F.col("focus") >= 0.5, "focused").otherwise("default")
    return out.select("query_id", "nodes", F.round("entropy", 6).alias("entropy"), F.round("focus", 6).alias("focus"), F.round(confidence, 6).alias("confidence"), verdict.alias("verdict"))


def matching_fibers(activations: DataFrame, members: DataFrame, fibers: DataFrame, *, now, nodes: int = 20, k: int = 10) -> DataFrame:
    """``(query_id, fiber_id, score, rank)``: fibers of the most active nodes by composite score."""
    best = top(activations, ["query_id"], [F.desc("level"), "node"], nodes).select("query_id", F.col("node").alias("neuron_id"), "level")
    hit = best.join(members, "neuron_id").groupBy("query_id", "fiber_id").agg(F.max("level").alias("activation"))
    age = S.days_between(F.lit(now).cast("timestamp_ntz"), F.col("created_at"))
    body = fibers.select(F.col("id").alias("fiber_id"), F.coalesce("salience", F.lit(0.0)).alias("salience"), F.coalesce("conductivity", F.lit(1.0)).alias("conductivity"), F.least(F.lit(1.0), F.coalesce("frequency", F.lit(0)) / 20).alias("frequency"), S.freshness(age).alias("fresh"))
    score = S.composite_score(F.col("activation"), F.col("salience"), F.col("frequency"), F.col("conductivity"), F.col("fresh"))
    return top(hit.join(body, "fiber_id").select("query_id", "fiber_id", F.round(score, 9).alias("score")), ["query_id"], [F.desc("score"), "fiber_id"], k)


def token_costs(fibers: DataFrame) -> DataFrame:
    """``(fiber_id, cost, value)`` by the words of the summary."""
    cost = F.greatest(F.lit(10), S.token_estimate(F.col("summary")) + 15)
    value = 0.1 * F.coalesce("salience", F.lit(0.0)) + 0.05 * F.coalesce("conductivity", F.lit(0.0)) + F.least(F.lit(1.0), F.coalesce("frequency", F.lit(0)) / 20)
    return fibers.select(F.col("id").alias("fiber_id"), cost.alias("cost"), F.round(value, 9).alias("value"))


def within_budget(items: DataFrame, *, group: str, budget: int) -> DataFrame:
    """Greedy choice of each group's items by value for cost; one that does not fit is passed over.

    ``items(group, fiber_id, cost, value)`` with positive costs; an ordered fold.  Once one of
    a cost does not fit, no later one of that cost does, so at most ``budget / cost`` of each
    cost are looked at.
    """
    k = (-F.col("value") / F.col("cost")).alias("k")
    few = top(items.select(group, "fiber_id", F.col("cost").cast("bigint").alias("cost"), k).where(F.col("cost") <= budget), [group, "cost"], ["k", "fiber_id"], budget)
    few = few.where(F.col("rank") * F.col("cost") <= budget)
    order = F.array_sort(F.collect_list(F.struct("k", "fiber_id", "cost")))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<string>").alias("taken"))
    fold = F.aggregate(
        order, start,
        lambda s, x: F.when(s["spent"] + x["cost"] <= budget, F.struct((s["spent"] + x["cost"]).alias("spent"), F.concat(s["taken"], F.array(x["fiber_id"])).alias("taken"))).otherwise(s),
    )
    out = few.groupBy(group).agg(fold.alias("s"))
    return out.select(group, F.col("s.spent").alias("spent"), F.posexplode("s.taken").alias("pos", "fiber_id"))


def prefix_budget(rows: DataFrame, *, order: list, cost: str, budget: int) -> DataFrame:
    """The longest prefix whose cost fits, by a running sum over each group."""
    total = F.sum(cost).over(Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)


def keep_first_near(rows: DataFrame, *, group: str, limit: int = 10, block: int = 16_384) -> DataFrame:
    """Near-duplicates by 64-bit hash removed, the best score first, within each group.

    ``rows(group, id, score, hash)``; a null or zero hash is like nothing.  Of a group with more
    than ``block`` hashes the first ``block`` rows are folded, what is near to those kept is
    sieved out in parallel, and so on with the rest.
    """
    kinds = dict(rows.dtypes)
    shape = f"{group} {kinds[group]}, id string, score {kinds['score']}, hash bigint, chunks bigint"

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values(["score", "id"], ascending=[False, True])
        hashes = frame["hash"].to_numpy(np.int64)
        kept, n = np.empty(len(hashes), np.int64), 0
        take = np.zeros(len(hashes), bool)
        for i, h in enumerate(hashes):
            if not n or np.bitwise_count((kept[:n] ^ h).view(np.uint64)).min() > limit:
                kept[n], take[i] = h, True
                n += 1
        return frame[take]

    def sieve(frame: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(kept):
            return frame
        near, hashes = kept["hash"].to_numpy(np.int64), frame["hash"].to_numpy(np.int64)
        far = np.ones(len(hashes), bool)
        for at in range(0, len(hashes), 64):
            far[at : at + 64] = np.bitwise_count((hashes[at : at + 64, None] ^ near[None, :]).view(np.uint64)).min(axis=1) > limit
        return frame[far]

    work = rows.select(group, "id", "score", F.col("hash").cast("bigint").alias("hash"))
    none = work.where("hash IS NULL OR hash = 0").select(group, "id")
    # only the first of equal hashes can stay
    firsts = cut(top(work.where("hash IS NOT NULL AND hash <> 0"), [group, "hash"], [F.desc("score"), "id"], 1).drop("rank"))
    sizes = firsts.groupBy(group).agg(F.ceil(F.count("*") / block).alias("chunks"))
    left = firsts.alias("f").join(sizes.alias("s"), F.col(f"f.{group}").eqNullSafe(F.col(f"s.{group}"))).select("f.*", "chunks")
    out = left.where("chunks = 1").groupBy(group).applyInPandas(keep, shape).select(group, "id").unionByName(none)
    left = cut(left.where("chunks > 1"))
    while not left.isEmpty():
        kept = cut(top(left, [group], [F.desc("score"), "id"], block).drop("rank").groupBy(group).applyInPandas(keep, shape))
        out = out.unionByName(kept.select(group, "id"))
        apart = left.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).groupBy(group, "chunk")
        each = kept.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).groupBy(group, "chunk")
        # the kept rows, and those of their block that were not, are near to a kept one themselves
        left = cut(apart.cogroup(each).applyInPandas(lambda a, b: sieve(a, b).drop(columns="chunk"), shape))
    return out


def evaluate(ranked: DataFrame, truth: DataFrame, *, k: int = 5) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG at ``k``, one row a query.

    ``ranked(query_id, id, rank)``, ``truth(query_id, id)``.  Recall of a query without
    relevant items is 1.
    """
    want = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.where(F.col("rank") <= k).join(truth.withColumn("hit", F.lit(1)), ["query_id", "id"])
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    n = F.coalesce("hits", F.lit(0))
    both = ranked.select("query_id").distinct().join(want, "query_id", "full").join(found, "query_id", "left")
    return both.select(
        "query_id", F.round(n / k, 6).alias("precision"), F.round(F.when(F.coalesce("relevant", F.lit(0)) == 0, 1.0).otherwise(n / F.col("relevant")), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.when(F.coalesce("relevant", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )
