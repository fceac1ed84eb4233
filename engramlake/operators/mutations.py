"""Writes as transforms: each takes a table and changes and gives the next version of the table.

Parquet has no row-level updates, so a write is a new version (``store.GraphStore``) or an
appended batch whose rows win over older ones when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, *, key: str = "id") -> DataFrame:
    """Rows replace those with the same key; of several new rows with one key one is kept."""
    fresh = rows.select(*table.columns).where(F.col(key).isNotNull()).dropDuplicates([key])
    return table.join(fresh.select(key), key, "left_anti").select(*table.columns).unionByName(fresh)


def update(table: DataFrame, changes: DataFrame, *, key: str = "id") -> DataFrame:
    """The named columns of rows with the same key take new values, nulls too; unknown keys do nothing.

    ``changes`` holds a key once.
    """
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), F.struct(*names).alias("_new"))
    both = table.join(new, key, "left")
    there = F.col("_new").isNotNull()
    return both.select(*[F.when(there, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, *, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def delete_neurons(neurons: DataFrame, synapses: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neurons without the keys, and synapses without an end among them."""
    gone = keys.select("id").distinct()
    edges = synapses.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return delete(neurons, gone), edges.select(*synapses.columns)


def drop_references(fibers: DataFrame, gone: DataFrame) -> DataFrame:
    """Fibers without deleted synapses in ``synapse_ids``; the order of what stays is kept."""
    refs = fibers.select("id", F.posexplode("synapse_ids").alias("pos", "s"))
    dead = refs.join(gone.select(F.col("id").alias("s")).distinct(), "s").groupBy("id").agg(F.collect_set("s").alias("dead"))  # members of one fiber
    both = fibers.join(dead, "id", "left")
    kept = F.when(F.col("dead").isNull(), F.col("synapse_ids")).otherwise(F.filter("synapse_ids", lambda s: s.isNull() | ~F.array_contains(F.col("dead"), s)))
    return both.select(*[kept.alias(c) if c == "synapse_ids" else F.col(c) for c in fibers.columns])


def delete_if_unchanged(table: DataFrame, expected: DataFrame, *, key: str = "id") -> DataFrame:
    """Rows go only if they still have the values that were seen, nulls included.

    ``expected`` holds the key and the columns to compare.
    """
    names = [c for c in expected.columns if c != key]
    seen = expected.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    same: Column = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    stale = table.join(seen, key).where(same).select(key)
    return delete(table, stale, key=key)


def move_brain(rows: DataFrame, brain: str) -> DataFrame:
    return rows.withColumn("brain_id", F.lit(brain))
