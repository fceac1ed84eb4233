"""Bulk encoding of texts into graph rows: anchors, concepts, entities, edges.

A pipeline is a list of steps, each a DataFrame transform; ``encode`` joins their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import encoding as steps
from engramlake.operators import memory


def prepare(docs: DataFrame) -> DataFrame:
    """Texts with what the steps need: type, keywords, entities, structure, scores."""
    x = F.col("text")
    return docs.where("text IS NOT NULL AND trim(text) <> ''").select(
        "doc_id", "text", "created_at", *[c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("brain_id", "source", "lang")], (F.coalesce("memory_type", T.memory_type(x)) if "memory_type" in docs.columns else T.memory_type(x)).alias("memory_type"), T.keywords(x).alias("keywords"), T.entities(x).alias("entities"),
        T.structure(x).alias("structure"), T.importance(x).alias("importance"), T.quality(x).alias("quality"),
    )


def concept_nodes(prepared: DataFrame) -> DataFrame:
    """Concepts by content, reused wherever the content is the same."""
    return prepared.select(F.explode("keywords").alias("content")).groupBy("content").agg(F.count("*").alias("mentions")).select(F.sha2(F.concat(F.lit("concept:"), "content"), 256).alias("id"), "content", "mentions")


def entity_nodes(prepared: DataFrame, *, least: int = 2) -> DataFrame:
    """Entities by normalised name, promoted after ``least`` mentions."""
    name = F.regexp_replace(F.lower("e"), r"[-_ ]+", " ")
    return prepared.select(F.explode("entities").alias("e")).groupBy(name.alias("name")).agg(F.count("*").alias("mentions"), F.min("e").alias("content")).where(F.col("mentions") >= least)


def anchor_edges(prepared: DataFrame) -> DataFrame:
    """Edges of each text's anchor to its entities (by mentions) and keywords (by position)."""
    mentions = F.size(F.split(F.col("text"), F.concat(F.lit("\\Q"), F.col("e"), F.lit("\\E")))) - 1
    ents = prepared.select("doc_id", "text", F.explode("entities").alias("e")).select("doc_id", F.lower("e").alias("target"), F.lit("involves").alias("type"), F.round(F.least(F.lit(0.95), 0.7 + 0.05 * mentions), 6).alias("weight"))
    keys = prepared.select("doc_id", F.posexplode("keywords").alias("pos", "target")).select("doc_id", "target", F.lit("related_to").alias("type"), F.round(F.least(F.lit(0.8), 0.4 + 0.3 * (1 - 0.05 * F.col("pos"))), 6).alias("weight"))
    return ents.unionByName(keys)


def entity_pairs(prepared: DataFrame) -> DataFrame:
    """CO_OCCURS pairs of the entities of one text, counted over all texts."""
    e = prepared.select(F.array_sort(F.array_distinct(F.transform("entities", lambda x: F.lower(x)))).alias("e")).where("size(e) > 1")
    return e.select(F.explode("e").alias("a"), "e").select("a", F.explode("e").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def relation_edges(prepared: DataFrame) -> DataFrame:
    return prepared.select("doc_id", F.explode(T.relations(F.col("text"))).alias("r")).select("doc_id", "r.source", "r.relation", "r.target")


def time_edges(prepared: DataFrame) -> DataFrame:
    """HAPPENED_AT edges to day nodes."""
    return prepared.where("created_at IS NOT NULL").select("doc_id", F.date_format("created_at", "yyyy-MM-dd").alias("target"), F.lit("happened_at").alias("type"), F.lit(0.9).alias("weight"))


def fiber_rows(prepared: DataFrame) -> DataFrame:
    """A fiber for each text: members, tags, coherence, salience."""
    n = F.size("keywords") + F.size("entities") + 1
    edges = F.size("keywords") + F.size("entities")
    coherence = F.when(n > 1, edges / (n * (n - 1) / 2)).otherwise(0.0)
    tags = F.slice(F.array_distinct(F.concat(F.transform("entities", lambda x: F.lower(x)), F.slice("keywords", 1, 5))), 1, 20)
    return prepared.select("doc_id", n.alias("members"), F.round(coherence, 6).alias("coherence"), F.round(F.least(F.lit(1.0), coherence + 0.3), 6).alias("salience"), tags.alias("auto_tags"))


def anchors(prepared: DataFrame) -> DataFrame:
    """``(doc_id, id, type, content, content_hash)``: the concept that stands for a whole text, with its similarity hash."""
    return prepared.select("doc_id", F.sha2(F.concat_ws(":", F.lit("anchor"), F.col("doc_id").cast("string")), 256).alias("id"), F.lit("concept").alias("type"), F.col("text").alias("content"), T.simhash(F.col("text")).alias("content_hash"))


def metadata(prepared: DataFrame) -> DataFrame:
    """``(doc_id, memory_type, structure, importance, quality, arousal)``."""
    return prepared.select("doc_id", "memory_type", "structure", "importance", "quality", F.round(T.arousal(F.col("text")), 6).alias("arousal"))


def shared_entities(prepared: DataFrame) -> DataFrame:
    mentions = prepared.select("doc_id", F.explode(F.array_distinct(F.transform("entities", lambda e: F.lower(e)))).alias("entity"))
    return steps.shared_entity_links(mentions)


DEFAULT = {
    "anchors": anchors, "times": time_edges, "entities": entity_nodes, "concepts": concept_nodes, "actions": steps.actions, "goals": steps.goals, "metadata": metadata, "decisions": memory.decisions, "copies": steps.copies,
    "anchor_edges": anchor_edges, "entity_pairs": entity_pairs, "feelings": lambda p: steps.feelings(p, memory.sentiment(F.col("text"))), "relations": relation_edges, "conflicts": lambda p: memory.resolve(memory.decisions(p)),
    "shared_entities": shared_entities, "fibers": fiber_rows, "context": steps.context,
}


def encode(docs: DataFrame, steps: dict | None = None) -> dict[str, DataFrame]:
    """Rows by step; a custom step is any function from prepared texts to a DataFrame."""
    prepared = prepare(docs)
    return {name: step(prepared) for name, step in (steps or DEFAULT).items()}
