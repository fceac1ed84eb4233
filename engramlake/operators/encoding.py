"""Further steps of the encode pipeline: actions, goals, feelings, copies, confirmed tags, links to what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators.scans import top

# What was done, what is meant to be done.
ACTION = r"\b(?:we|i|they|he|she|team)\s+((?:used|[a-z]{3,}ed)(?:\s+[a-z]+){1,3})"
GOAL = r"\b(?:need to|want to|plan to|remember to|goal is to|must|should)\s+([a-z]+(?:\s+[a-z]+){1,4})"


def _phrases(docs: DataFrame, pattern: str, kind: str, weight: float) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("target")).select("doc_id", "target", F.lit(kind).alias("type"), F.lit(weight).alias("weight"))


def actions(docs: DataFrame) -> DataFrame:
    """``(doc_id, target, type, weight)``: INVOLVES edges to verb phrases of what somebody did."""
    return _phrases(docs, ACTION, "involves", 0.6)


def goals(docs: DataFrame) -> DataFrame:
    """``(doc_id, target, type, weight)``: edges to what somebody means to do."""
    return _phrases(docs, GOAL, "intends", 0.7)


def feelings(docs: DataFrame, valence: Column) -> DataFrame:
    """``(doc_id, state, weight)``: FELT edges of the texts that are not neutral, by the strength of the feeling."""
    v = docs.select("doc_id", valence.alias("v")).where("v <> 0")
    return v.select("doc_id", F.when(F.col("v") > 0, "positive").otherwise("negative").alias("state"), F.round(F.abs("v") * 0.8, 6).alias("weight"))


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, original)``: texts that an earlier document already holds (case and outer blanks apart).

    The first of a text is found by an aggregate, so a text with any number of copies is no single task.
    """
    canon = docs.where("text IS NOT NULL AND trim(text) <> ''").select("doc_id", "created_at", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    first = canon.groupBy("h").agg(F.min(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "doc_id")).alias("m"))
    return canon.join(first, "h").where(F.col("doc_id") != F.col("m.doc_id")).select("doc_id", F.col("m.doc_id").alias("original"))


def confirmed(fibers: DataFrame) -> DataFrame:
    """``(fiber_id, both, boost)``: fibers of which a tag was given by the engine and by an agent."""
    empty = F.array().cast("array<string>")
    both = F.size(F.array_intersect(F.array_compact(F.coalesce("auto_tags", empty)), F.array_compact(F.coalesce("agent_tags", empty))))
    return fibers.select(F.col("id").alias("fiber_id"), both.alias("both")).where("both > 0").withColumn("boost", F.lit(0.1))


def agent_links(fibers: DataFrame, members: DataFrame, neurons: DataFrame) -> DataFrame:
    """``(fiber_id, neuron_id, tag, weight)``: tags that only an agent gave, with the members whose text holds them."""
    empty = F.array().cast("array<string>")
    only = F.array_except(F.array_compact(F.coalesce("agent_tags", empty)), F.coalesce("auto_tags", empty))
    tags = fibers.select(F.col("id").alias("fiber_id"), F.explode(only).alias("tag"))
    text = neurons.where("content IS NOT NULL").select(F.col("id").alias("neuron_id"), F.lower("content").alias("content"))
    return tags.join(members, "fiber_id").join(text, "neuron_id").where(F.contains("content", F.lower("tag"))).select("fiber_id", "neuron_id", "tag", F.lit(0.3).alias("weight"))


def same_content_links(new: DataFrame, old: DataFrame, *, first: int = 20, each: int = 5) -> DataFrame:
    """``(source_id, target_id, weight)``: a brain's first new neurons with old ones of the same type and content.

    A pass looks at ``first`` new neurons of a brain and links each to at most ``each`` old ones.
    """
    fresh = top(new.where("content IS NOT NULL AND trim(content) <> ''"), ["brain_id"], ["created_at", "id"], first).select("brain_id", F.col("id").alias("source_id"), "type", "content")
    near = fresh.join(old.select("brain_id", F.col("id").alias("target_id"), "type", "content"), ["brain_id", "type", "content"])
    return top(near, ["source_id"], ["target_id"], each).select("source_id", "target_id", F.lit(0.4).alias("weight"))


def shared_entity_links(mentions: DataFrame, *, hub: int = 50, per_entity: int = 5, each: int = 15) -> DataFrame:
    """``(doc_id, other, shared, weight)``: earlier texts that name the same entities.

    ``mentions(doc_id, entity)``.  An entity in more than ``hub`` texts says nothing; of each
    other one the ``per_entity`` latest earlier texts count, and a text keeps ``each`` links.
    """
    rare = mentions.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") <= hub).select("entity")
    m = mentions.join(rare, "entity")
    pair = m.join(m.select("entity", F.col("doc_id").alias("other")), "entity").where("other < doc_id")  # at most hub squared a key
    close = top(pair, ["doc_id", "entity"], [F.desc("other")], per_entity).groupBy("doc_id", "other").agg(F.count("*").alias("shared"))
    best = top(close, ["doc_id"], [F.desc("shared"), F.desc("other")], each)
    return best.select("doc_id", "other", "shared", F.round(F.least(F.lit(0.7), 0.3 + 0.1 * (F.col("shared") - 1)), 6).alias("weight"))


def context(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``: a hash of the surroundings a text was written in."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))
    return docs.select("doc_id", F.sha2(F.concat_ws("|", part("brain_id"), part("source"), part("memory_type"), F.lower(part("lang")), day), 256).alias("fingerprint"))
