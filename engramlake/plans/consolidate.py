"""Maintenance strategies by name; each gives the rows it would change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.functions import text as T
from engramlake.operators import clusters, graph, linking, maintenance, scans, sequences, stats


def strategies(neurons: DataFrame, synapses: DataFrame, fibers: DataFrame, co_activations: DataFrame, documents: DataFrame, events: DataFrame, *, now) -> dict[str, Callable[[], DataFrame]]:
    """Lazy plans of the passes over one snapshot.

    ``events(user_id, event_type, ts, event_id)`` are uses of tools by session.
    """
    t = F.lit(now).cast("timestamp_ntz")
    members = lambda: fibers.select(F.col("id").alias("fiber_id"), F.explode(F.array_distinct(F.array_compact("neuron_ids"))).alias("neuron_id"))
    states = lambda: scans.neuron_states(neurons, synapses)
    tags = lambda: fibers.select(F.col("id").alias("fiber_id"), F.explode(F.array_compact(scans.tags_of(fibers))).alias("tag")).distinct()
    counts = lambda: tags().groupBy("tag").agg(F.count("*").alias("fibers"))
    used = lambda: events.select(F.col("user_id").alias("session"), F.col("event_type").alias("action"), F.col("ts").alias("at"), "event_id")
    often = F.coalesce("frequency", F.lit(0))
    stage = sequences.stage(S.days_between(t, F.col("created_at")) * 24, often, often / 2)
    named = lambda: neurons.where("type = 'schema' AND content IS NOT NULL").select(F.lower("content").alias("name")).distinct()
    traces = lambda: fibers.where("size(pathway) > 1").select(F.col("id"), F.array_compact("pathway").alias("a"), F.array_compact("neuron_ids").alias("b"))
    return {
        "prune": lambda: maintenance.prune_candidates(synapses, neurons, fibers, now=now),
        "merge": lambda: clusters.merge_fibers(members()).where("fiber_id <> merged_into"),
        "summarize": lambda: tags().join(clusters.tag_clusters(stats.tag_cooccurrence(tags()), counts(), link=0.03), "tag").groupBy("canonical").agg(F.countDistinct("fiber_id").alias("fibers")).where("fibers > 1"),
        "mature": lambda: fibers.select("id", stage.alias("stage")).where("stage = 'semantic'"),
        "infer": lambda: maintenance.infer_edges(stats.co_activation_counts(co_activations), synapses),
        "enrich": lambda: graph.transitive_closures(synapses, "caused_by"),
        "dream": lambda: maintenance.dream(synapses, neurons),
        "learn_habits": lambda: sequences.habits(sequences.sequential_pairs(used(), window_s=86400), least=3, sessions=100),
        "dedup": lambda: scans.near_hashes(neurons, limit=7),
        "semantic_link": lambda: linking.semantic_links(neurons, synapses),
        "compress": lambda: maintenance.compression_tier(fibers, now=now).where("tier > 0"),
        "lifecycle": lambda: maintenance.lifecycle(neurons, states(), now=now),
        "essence_backfill": lambda: documents.where("text IS NOT NULL").select("doc_id", T.essence(F.col("text")).alias("essence")).where("essence IS NOT NULL"),
        "process_tool_events": lambda: sequences.tool_pairs(used(), window_s=3600),
        "detect_drift": lambda: tags().groupBy(F.lower("tag").alias("t")).agg(F.countDistinct("tag").alias("variants")).where("variants > 1"),
        "replay": lambda: maintenance.replay_salient(synapses, fibers, members()),
        "schema": lambda: tags().join(named(), F.lower("tag") == F.col("name"), "left_anti").groupBy("tag").agg(F.count("*").alias("fibers")).where("fibers >= 10"),
        "interference": lambda: clusters.fan_effect(tags()),
        "process_reasoning_traces": lambda: traces().select("id", F.size("a").alias("steps")).where("steps > 1"),
        "learn_reasoning": lambda: clusters.common_subsequence(traces()).where("length > 1"),
        "decay": lambda: maintenance.decay_edges(synapses, now=now),
        "strengthen": lambda: maintenance.boost_frequent(synapses, fibers),
        "normalise": lambda: maintenance.normalise_outgoing(synapses),
        "tiers": lambda: maintenance.tier_moves(fibers, now=now),
        "orphans": lambda: stats.orphans(neurons, synapses, members()),
    }
