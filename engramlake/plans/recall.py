"""Bulk recall: many queries in one job, from text to ranked fibers.

Anchors come from several retrievers, their ranks are fused, activation spreads from the
fused levels, disputed nodes are held back, and fibers are ranked by a composite score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.operators import graph, memory, ranking, scans
from engramlake.runtime import cut


def _words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(S.search_tokens(F.col("query")))).alias("word"))


def postings(neurons: DataFrame) -> DataFrame:
    """``(neuron_id, type, word)``, distinct: the words of every content."""
    return neurons.where("content IS NOT NULL").select(F.col("id").alias("neuron_id"), "type", F.explode(F.array_distinct(S.search_tokens(F.col("content")))).alias("word"))


def by_text(queries: DataFrame, neurons: DataFrame, *, k: int = 10) -> DataFrame:
    """``(query_id, neuron_id, rank)``: full-text hits."""
    return scans.bm25(neurons, queries, least_chars=1, k=k).select("query_id", F.col("id").alias("neuron_id"), "rank")


def by_entity(queries: DataFrame, neurons: DataFrame, *, k: int = 3, words: DataFrame | None = None) -> DataFrame:
    """``(query_id, neuron_id, rank)``: entities by the number of the question's words in their name."""
    named = postings(neurons) if words is None else words
    hit = named.where("type = 'entity'").join(_words(queries), "word").groupBy("query_id", "neuron_id").agg(F.count("*").alias("n"))
    return scans.top(hit, ["query_id"], [F.desc("n"), "neuron_id"], k).select("query_id", "neuron_id", "rank")


def _stems(word: Column) -> Column:
    """A word and what is left of it without each one of its characters: words one edit apart share one."""
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))), word))


def by_spelling(queries: DataFrame, neurons: DataFrame, *, least: int = 5, k: int = 5, words: DataFrame | None = None) -> DataFrame:
    """``(query_id, neuron_id, rank)``: neurons with a word one edit away from a word that fewer than two hold.

    Words of at least ``least`` letters.  Deletion stems turn the edit distance into an
    equality join; the distance is then checked.
    """
    asked = _words(queries).where(F.length("word") >= least)
    held = (cut(postings(neurons)) if words is None else words).select("neuron_id", F.col("word").alias("other"))  # used three times
    known = held.join(asked.select(F.col("word").alias("other")).distinct(), "other", "left_semi").groupBy("other").agg(F.count("*").alias("n")).where("n >= 2")
    rare = asked.join(known.select(F.col("other").alias("word")), "word", "left_anti")
    vocabulary = held.where(F.length("other") >= least - 1).select("other").distinct()
    stems = vocabulary.select("other", F.explode(_stems(F.col("other"))).alias("stem"))
    near = rare.select("query_id", "word", F.explode(_stems(F.col("word"))).alias("stem")).join(stems, "stem")
    near = near.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other") == 1)).select("query_id", "other").distinct()
    hit = held.join(near, "other").groupBy("query_id", "neuron_id").agg(F.count("*").alias("n"))
    return scans.top(hit, ["query_id"], [F.desc("n"), "neuron_id"], k).select("query_id", "neuron_id", "rank")


def by_time(queries: DataFrame, neurons: DataFrame, *, now, k: int = 5) -> DataFrame:
    """``(query_id, neuron_id, rank)``: the newest neurons of the time that a question names, seen from ``now`` or its own ``at``."""
    at = F.col("at") if "at" in queries.columns else F.lit(now).cast("timestamp_ntz")
    asked = queries.select("query_id", memory.time_range(F.col("query"), at).alias("r")).where("r IS NOT NULL")
    asked = asked.select("query_id", F.explode(F.sequence(F.to_date("r.start"), F.to_date(F.col("r.end") - F.make_dt_interval(secs=F.lit(1))))).alias("day"))
    dated = neurons.where("created_at IS NOT NULL").select(F.col("id").alias("neuron_id"), "created_at", F.to_date("created_at").alias("day"))
    return scans.top(dated.join(asked, "day"), ["query_id"], [F.desc("created_at"), "neuron_id"], k).select("query_id", "neuron_id", "rank")


def by_graph(anchors: DataFrame, synapses: DataFrame, *, least: float = 0.3, k: int = 10) -> DataFrame:
    """``(query_id, neuron_id, rank)``: what the anchors' strongest edges lead to, anchors apart."""
    own = anchors.select("query_id", "neuron_id").distinct()
    edges = graph.directed(synapses, least_weight=least)
    hit = own.join(edges, F.col("neuron_id") == F.col("src")).groupBy("query_id", F.col("dst").alias("neuron_id")).agg(F.max("weight").alias("w"))
    fresh = hit.join(own, ["query_id", "neuron_id"], "left_anti")
    return scans.top(fresh, ["query_id"], [F.desc("w"), "neuron_id"], k).select("query_id", "neuron_id", "rank")


def anchors(queries: DataFrame, neurons: DataFrame, synapses: DataFrame, *, now, vectors: DataFrame | None = None) -> DataFrame:
    """``(query_id, retriever, neuron_id, rank)`` of the text, entity, spelling, time and graph retrievers.

    ``queries(query_id, query)`` is a batch of questions, with ``at`` where they have times of
    their own; its words are the small side of every join.  ``vectors(query_id, neuron_id,
    rank)`` are hits of an embedding search where the questions were embedded.
    """

    def listed(**found: DataFrame) -> DataFrame:
        out = None
        for name, rows in found.items():
            part = rows.select("query_id", F.lit(name).alias("retriever"), "neuron_id", "rank")
            out = part if out is None else out.unionByName(part)
        return out

    words = cut(postings(neurons))  # used by two retrievers
    first = cut(listed(keyword=by_text(queries, neurons), entity=by_entity(queries, neurons, words=words)))  # used twice
    rest = listed(fuzzy=by_spelling(queries, neurons, words=words), time=by_time(queries, neurons, now=now), graph=by_graph(first, synapses), **({} if vectors is None else {"embedding": vectors}))
    return first.unionByName(rest)


def recall(queries: DataFrame, neurons: DataFrame, synapses: DataFrame, fibers: DataFrame, *, now, k: int = 10, valid_at=None, vectors: DataFrame | None = None) -> DataFrame:
    """``(query_id, fiber_id, score, rank)`` for a batch of questions; with ``valid_at`` only fibers valid then."""
    fused = ranking.to_levels(ranking.fuse(anchors(queries, neurons, synapses, now=now, vectors=vectors)))
    start = fused.select("query_id", F.col("neuron_id").alias("node"), "level")
    active = graph.spread(graph.directed(synapses), start, max_hops=3).select("query_id", "node", "level")
    kept = ranking.deprioritise(active, neurons)
    if valid_at is not None:
        fibers = fibers.where(scans.valid_at(valid_at))
    members = fibers.select(F.col("id").alias("fiber_id"), F.explode(F.array_distinct(F.array_compact("neuron_ids"))).alias("neuron_id"))
    return ranking.matching_fibers(kept, members, fibers, now=now, k=k)
