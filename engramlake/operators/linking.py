"""Links by meaning, and shorter forms of fibers by age."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.text import sentences
from engramlake.operators.scans import top, usable
from engramlake.runtime import cut, ship

#: Neurons that one pass of ``semantic_links`` asks for, at most: 5 MB at 64 coordinates.
PASS = 10_000


def semantic_links(neurons: DataFrame, synapses: DataFrame, *, size: int = 64, least: float = 0.7, k: int = 5, most: int | None = None) -> DataFrame:
    """``(a, b, cos, weight)``: concepts and entities of like meaning that no edge joins yet, smaller id first.

    A pass asks for the ``PASS`` least connected neurons (ties by id) and compares them with
    all concepts and entities: the asked vectors are broadcast and every batch of rows is
    one matrix product, of which the ``k`` best an asked neuron go on.  ``weight`` is 0.6
    times the cosine; ``most`` keeps the best links only, where a budget is wanted.
    """
    spark = neurons.sparkSession
    ship(spark)
    rows = cut(neurons.where(F.col("type").isin("concept", "entity") & (F.trim("content") != "")).where(usable("embedding", size)).select("id", F.col("embedding").cast("array<double>").alias("embedding")))
    degree = synapses.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    asked = rows.join(degree, "id", "left").orderBy(F.coalesce("d", F.lit(0)), "id").limit(PASS).select("id", "embedding").collect()  # at most PASS rows
    names = np.array([r.id for r in asked], object)
    matrix = np.array([r.embedding for r in asked], np.float64).reshape(-1, size)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast((names, matrix))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                other = part.column(0).to_numpy(zero_copy_only=False)
                v = part.column(1).flatten().to_numpy().reshape(-1, size)
                cos = unit @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                cos[ids[:, None] == other[None, :]] = -2
                keep = min(k + 8, cos.shape[1])  # ties at the edge are settled below
                floor = np.partition(cos, cos.shape[1] - keep, axis=1)[:, cos.shape[1] - keep]
                x, y = np.nonzero((cos >= least - 1e-9) & (cos >= floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.string()), pa.array(other[y], pa.string()), pa.array(np.round(cos[x, y], 9))], names=["id", "other", "cos"])

    found = top(rows.mapInArrow(compare, "id string, other string, cos double").where(F.col("cos") >= least), ["id"], [F.desc("cos"), "other"], k)
    pair = found.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cos").alias("cos"))
    there = synapses.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    new = pair.join(there, ["a", "b"], "left_anti").select("a", "b", F.round("cos", 6).alias("cos"), F.round(F.col("cos") * 0.6, 6).alias("weight"))
    return new if most is None else new.orderBy(F.desc("cos"), "a", "b").limit(most)


def entity_density(sentence: Column, contents: Column) -> Column:
    """How many of the contents a sentence holds, for each of its words, at most 1."""
    words = F.size(F.filter(F.split(sentence, r"\s+"), lambda w: w != ""))
    held = F.size(F.filter(contents, lambda c: (c != "") & F.contains(F.lower(sentence), F.lower(c))))
    return F.when(words == 0, 0.0).otherwise(F.least(F.lit(1.0), held / words))


def extractive(text: Column, contents: Column, most: int = 3) -> Column:
    """Tier 1: the first sentence and the densest others, ``most`` in all, in their order."""

    def pick(parts: Column) -> Column:
        scored = F.transform(parts, lambda s, i: F.struct(F.when(i == 0, -2.0).otherwise(-entity_density(s, contents)).alias("d"), i.alias("i"), s.alias("s")))
        best = F.slice(F.array_sort(scored), 1, most)
        return F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")

    return F.transform(F.array(sentences(text)), pick)[0]


def entity_preserving(text: Column, contents: Column) -> Column:
    """Tier 2: the sentences that hold any of the contents."""
    return F.array_join(F.filter(sentences(text), lambda s: entity_density(s, contents) > 0), " ")


def template(contents: Column, relations: Column) -> Column:
    """Tier 3: neighbouring contents joined by their relation (the first one where there is none of their own)."""
    named = F.filter(contents, lambda c: c != "")

    def render(c: Column) -> Column:
        first = F.coalesce(F.get(relations, 0), F.lit("related_to"))
        parts = F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat_ws(" ", F.get(c, i), F.coalesce(F.get(relations, i), first), F.get(c, i + 1)))
        return F.when(F.size(c) == 0, "").when(F.size(c) == 1, F.get(c, 0)).otherwise(F.array_join(F.when(F.size(c) > 1, parts), "; "))

    return F.transform(F.array(named), render)[0]


def fiber_contents(fibers: DataFrame, neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """``(fiber_id, summary, contents, relations)``: what a fiber's members and edges say, in its order."""
    said = neurons.where("content IS NOT NULL").select(F.col("id").alias("m"), "content")
    of = fibers.select(F.col("id").alias("fiber_id"), F.posexplode(F.array_distinct(F.array_compact("neuron_ids"))).alias("pos", "m")).join(said, "m")
    contents = of.groupBy("fiber_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("contents"))  # members of one fiber
    kinds = synapses.where("type IS NOT NULL").select(F.col("id").alias("s"), "type")
    tied = fibers.select(F.col("id").alias("fiber_id"), F.posexplode(F.array_distinct(F.array_compact("synapse_ids"))).alias("pos", "s")).join(kinds, "s")
    relations = tied.groupBy("fiber_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("relations"))  # edges of one fiber
    empty = F.array().cast("array<string>")
    rows = fibers.select(F.col("id").alias("fiber_id"), "summary").join(contents, "fiber_id", "left").join(relations, "fiber_id", "left")
    return rows.select("fiber_id", "summary", F.coalesce("contents", empty).alias("contents"), F.coalesce("relations", empty).alias("relations"))
