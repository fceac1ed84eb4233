"""Counts, health and evolution of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.operators.sequences import stage


def edge_type_stats(synapses: DataFrame) -> DataFrame:
    return synapses.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.sum("reinforced_count").alias("reinforced"))


def graph_summary(neurons: DataFrame, synapses: DataFrame, fibers: DataFrame) -> DataFrame:
    """One row of counts."""
    a = neurons.agg(F.count("*").alias("neurons"), F.count_if(F.col("metadata.is_anchor")).alias("anchors"))
    b = synapses.agg(F.count("*").alias("synapses"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    c = fibers.agg(F.count("*").alias("fibers"), F.min("created_at").alias("first_fiber"), F.max("created_at").alias("last_fiber"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def co_activation_counts(co: DataFrame, *, since=None, until=None, least: int = 1) -> DataFrame:
    """Canonical pairs with their counts and mean strength over ``(since, until]``.

    Means are made of decimals, so the order of the rows can't move one that lies half way
    between two roundings; strengths that are no such decimal (not finite, 1e10 or more)
    leave their pair with the mean of floats.
    """
    rows = co.where("neuron_a IS NOT NULL AND neuron_b IS NOT NULL AND neuron_a <> neuron_b")
    if since is not None:
        rows = rows.where(F.col("created_at") > F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    pair = rows.groupBy(F.least("neuron_a", "neuron_b").alias("a"), F.greatest("neuron_a", "neuron_b").alias("b"))
    exact = F.col("binding_strength").try_cast("decimal(28,18)")
    mean = F.when(F.count(exact) == F.count("binding_strength"), F.round(F.avg(exact), 6).cast("double")).otherwise(F.round(F.avg("binding_strength"), 6))
    return pair.agg(F.count("*").alias("n"), mean.alias("strength")).where(F.col("n") >= least)


def tag_cooccurrence(tags: DataFrame, *, least: int = 2) -> DataFrame:
    """``(a, b, n)`` from ``(fiber_id, tag)``; pairs are made from one fiber's sorted tags."""
    sets = tags.groupBy("fiber_id").agg(F.array_sort(F.collect_set("tag")).alias("t")).where("size(t) > 1")  # tags of one fiber
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def orphans(neurons: DataFrame, synapses: DataFrame, members: DataFrame) -> DataFrame:
    """Neurons that no edge and no fiber holds."""
    used = synapses.select(F.explode(F.array("source_id", "target_id")).alias("id")).union(members.select("neuron_id")).distinct()
    return neurons.select("id", "brain_id").join(used, "id", "left_anti")


#: Edge types that are bookkeeping, not memory. Fixed values.
STRUCTURAL = ("alias", "stored_by", "verified_at", "approved_by", "source_of")


def health(neurons: DataFrame, synapses: DataFrame, members: DataFrame, fibers: DataFrame, states: DataFrame, *, now, days: float = 7) -> DataFrame:
    """One row a brain: the seven weighted parts of its health, the penalty for conflicts, score and grade.

    Connectivity counts edges that are not structural; freshness and consolidation are the
    shares of fibers (none of the code index) used within ``days`` and of semantic stage.
    A brain without fibers has no row.
    """
    n = neurons.groupBy("brain_id").agg(F.count("*").alias("n"))
    e = synapses.groupBy("brain_id").agg(F.count("*").alias("e"), F.count_if(~F.lower("type").isin(*STRUCTURAL)).alias("organic"), F.count_if(F.lower("type") == "contradicts").alias("against"), F.avg("weight").alias("w"))
    kinds = synapses.groupBy("brain_id", "type").agg(F.count("*").alias("k"))
    share = F.col("k") / F.col("e")
    diversity = kinds.join(e.select("brain_id", "e"), "brain_id").groupBy("brain_id").agg((-F.sum(share * F.log(share)) / F.log(F.lit(8.0))).alias("d"))
    t = F.lit(now).cast("timestamp_ntz")
    coded = F.array_contains(F.array_union(F.coalesce("auto_tags", F.array().cast("array<string>")), F.coalesce("agent_tags", F.array().cast("array<string>"))), "code_index")
    used = F.coalesce("frequency", F.lit(0))
    fresh = fibers.where(~coded).groupBy("brain_id").agg(
        F.avg((S.days_between(t, F.coalesce("last_conducted", "created_at")) <= days).cast("double")).alias("fresh"),
        F.avg((stage(S.days_between(t, F.col("created_at")) * 24, used, used / 2) == "semantic").cast("double")).alias("semantic"),
    )
    lone = orphans(neurons, synapses, members).groupBy("brain_id").agg(F.count("*").alias("lone"))
    busy = neurons.join(states, F.col("id") == F.col("neuron_id")).groupBy("brain_id").agg(F.avg((F.col("access_frequency") > 0).cast("double")).alias("eff"))
    rows = n.join(e, "brain_id", "left").join(diversity, "brain_id", "left").join(fresh, "brain_id").join(lone, "brain_id", "left").join(busy, "brain_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    connectivity = S.sigmoid(1.5 * (zero("organic") / F.col("n") - 3))
    orphan, penalty = zero("lone") / F.col("n"), F.least(F.lit(10.0), 50 * zero("against") / F.col("n"))
    parts = 0.25 * connectivity + 0.20 * F.least(F.lit(1.0), zero("d")) + 0.15 * zero("fresh") + 0.15 * zero("semantic") + 0.10 * (1 - orphan) + 0.10 * zero("eff") + 0.05 * S.clamp(zero("w"), 0.0, 1.0)
    score = F.greatest(F.lit(0.0), 100 * parts - penalty)
    return rows.select(
        "brain_id", F.round(connectivity, 6).alias("connectivity"), F.round(F.least(F.lit(1.0), zero("d")), 6).alias("diversity"), F.round(zero("fresh"), 6).alias("freshness"), F.round(zero("semantic"), 6).alias("consolidation"),
        F.round(orphan, 6).alias("orphan_rate"), F.round(penalty, 6).alias("penalty"), F.round(score, 4).alias("score"), S.grade(score).alias("grade"),
    )


def uncertainty(synapses: DataFrame, neurons: DataFrame, memories: DataFrame, *, now, days: int = 14, low: float = 0.4) -> DataFrame:
    """One row a brain: contradictions, low evidence, superseded, expiring, drifting tags, and the level they give.

    ``memories(brain_id, trust, expires_at)``; a tag drifts where a brain spells it in more
    than one way.
    """
    a = synapses.where("type = 'contradicts'").groupBy("brain_id").agg(F.count("*").alias("contradictions"))
    t = F.lit(now).cast("timestamp_ntz")
    b = memories.groupBy("brain_id").agg(F.count_if(F.col("trust") <= low).alias("low_evidence"), F.count_if((F.col("expires_at") > t) & (F.col("expires_at") <= t + F.make_dt_interval(days=F.lit(days)))).alias("expiring"))
    c = neurons.groupBy("brain_id").agg(F.count_if("metadata.superseded").alias("superseded"))
    tags = neurons.select("brain_id", F.explode("metadata.tags").alias("tag")).where("tag IS NOT NULL").groupBy("brain_id", F.lower("tag").alias("t")).agg(F.countDistinct("tag").alias("k"))
    d = tags.groupBy("brain_id").agg(F.count_if(F.col("k") > 1).alias("drift"))
    names = ("contradictions", "low_evidence", "superseded", "expiring", "drift")
    rows = c.join(a, "brain_id", "left").join(b, "brain_id", "left").join(d, "brain_id", "left").select("brain_id", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in names])
    level = F.when((F.col("contradictions") > 0) | (F.col("low_evidence") > 0), "high").when((F.col("superseded") > 0) | (F.col("expiring") > 0) | (F.col("drift") > 0), "medium").otherwise("low")
    return rows.withColumn("level", level)


def evolution(neurons: DataFrame, synapses: DataFrame, fibers: DataFrame, *, now) -> DataFrame:
    """One row a brain: plasticity, activity, decay."""
    t = F.lit(now).cast("timestamp_ntz")
    week = lambda c: S.days_between(t, F.col(c)) <= 7
    p = synapses.groupBy("brain_id").agg(F.avg((F.coalesce(week("created_at"), F.lit(False)) | F.coalesce(week("last_activated"), F.lit(False))).cast("double")).alias("plasticity"))
    a = fibers.groupBy("brain_id").agg(
        F.avg(F.coalesce(week("last_conducted"), F.lit(False)).cast("double")).alias("activity"), S.sigmoid(-0.1 * (S.days_between(t, F.max(F.coalesce("last_conducted", "created_at"))) - 30)).alias("decay")
    )
    return neurons.select("brain_id").distinct().join(p, "brain_id", "left").join(a, "brain_id", "left").select("brain_id", *[F.round(c, 6).alias(c) for c in ("plasticity", "activity", "decay")])


def extrapolate(trajectories: DataFrame, *, steps: int = 3, energy: float = 0.99) -> DataFrame:
    """Linear (dynamic mode) extrapolation of each group's series, ``(group, step, values)``.

    ``trajectories(group, step, values array<double>)``; a group is one recall's recorded
    steps, so it is small.
    """
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step")
        x = np.stack(frame["values"].to_list()).T
        if x.shape[1] < 3:
            future = [x[:, -1]] * steps
        else:
            u, s, v = np.linalg.svd(x[:, :-1], full_matrices=False)
            r = max(1, int(np.searchsorted(np.cumsum(s**2) / max((s**2).sum(), 1e-12), energy) + 1))
            u, s, v = u[:, :r], s[:r], v[:r]
            a = u.T @ x[:, 1:] @ v.T / np.maximum(s, 1e-12)
            z, future = u.T @ x[:, -1], []
            for _ in range(steps):
                z = a @ z
                future.append(u @ z)
        last = int(frame["step"].iloc[-1])
        return pd.DataFrame({"group": frame["group"].iloc[0], "step": [last + i + 1 for i in range(steps)], "values": [f.round(9).tolist() for f in future]})

    kind = dict(trajectories.dtypes)["group"]
    return trajectories.select("group", "step", "values").groupBy("group").applyInPandas(run, f"group {kind}, step int, values array<double>")
