"""Snapshots: diff, merge, subgraphs, Merkle hashes, change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint():
    """Identity of a neuron across snapshots: type and lower-case content."""
    return F.concat_ws(":", "type", F.lower("content"))


def diff(old: DataFrame, new: DataFrame, *, key: str = "id", compare: list[str]) -> DataFrame:
    """``(key, change)``: added, removed or modified (null-safe comparison of some columns)."""
    a = old.select(key, F.struct(*compare).alias("_old"))
    b = new.select(key, F.struct(*compare).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def merge_snapshots(left: DataFrame, right: DataFrame, *, prefer: str = "newest") -> DataFrame:
    """Neurons of two snapshots by fingerprint, ``(fingerprint, id, from)``.

    ``prefer`` is ``left``, ``right``, ``newest`` or ``priority``; ties keep the left one.
    """
    pick = lambda rows, name: rows.groupBy(fingerprint().alias("fingerprint")).agg(F.min(F.struct("id", "created_at", F.coalesce("metadata.priority", F.lit(0)).alias("priority"))).alias(name))
    both = pick(left, "l").join(pick(right, "r"), "fingerprint", "full")
    wins = {"left": F.lit(False), "right": F.lit(True), "newest": F.col("r.created_at") > F.col("l.created_at"), "priority": F.col("r.priority") > F.col("l.priority")}[prefer]
    take = F.when(F.col("l").isNull(), True).when(F.col("r").isNull(), False).otherwise(F.coalesce(wins, F.lit(False)))
    return both.select("fingerprint", F.when(take, F.col("r.id")).otherwise(F.col("l.id")).alias("id"), F.when(take, "right").otherwise("left").alias("from"))


def subgraph(neurons: DataFrame, synapses: DataFrame, *, types: list[str], tags: list[str], least_priority: int = 0) -> tuple[DataFrame, DataFrame]:
    """Neurons that meet all criteria (any of the tags, ignoring case) and the edges among them."""
    has = F.exists("metadata.tags", lambda t: F.lower(t).isin([x.lower() for x in tags]))
    nodes = neurons.where(F.col("type").isin(types) & F.coalesce(has, F.lit(False)) & (F.coalesce("metadata.priority", F.lit(0)) >= least_priority))
    ids = nodes.select("id")
    edges = synapses.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def leaf_hashes(rows: DataFrame, columns: list[str], *, key: str = "id") -> DataFrame:
    return rows.select(key, F.sha2(F.concat_ws("|", key, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("hash"))


def merkle_buckets(leaves: DataFrame, *, widths: tuple[int, ...] = (6, 4, 2)) -> DataFrame:
    """``(bucket, leaves, hash)``: a hash tree over prefixes of the leaf hashes.

    A node's hash is that of its sorted children.  Each level drops two hex characters, so a
    node has at most 256 children; the lowest level's nodes hold a sixteen-millionth of the
    leaves each (give more widths for larger tables).
    """
    level = leaves.select(F.col("hash").alias("path"), "hash", F.lit(1).cast("bigint").alias("leaves"))
    for width in widths:
        level = level.groupBy(F.substring("path", 1, width).alias("path")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"), F.sum("leaves").alias("leaves")
        )
    return level.select(F.col("path").alias("bucket"), "leaves", "hash")


def merkle_root(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"]), ""), 256).alias("root"))  # one entry a bucket


def merge_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(entity_type, entity_id, winner)`` of the latest local and remote change of each entity; a delete wins, then the later, then the local."""
    last = lambda rows, name: rows.groupBy("entity_type", "entity_id").agg(F.max(F.struct("sequence", "receipt_id", "operation")).alias(name))
    both = last(local, "l").join(last(remote, "r"), ["entity_type", "entity_id"], "full")
    l, r = F.col("l"), F.col("r")
    winner = F.when(r.isNull(), "local").when(l.isNull(), "remote").when(F.col("l.operation") == "delete", "local").when(F.col("r.operation") == "delete", "remote").when(F.col("r.sequence") > F.col("l.sequence"), "remote").otherwise("local")
    return both.select("entity_type", "entity_id", winner.alias("winner"))


def merge_payloads(pairs: DataFrame) -> DataFrame:
    """Field-wise merge of two versions of a fiber: strengths by maximum, counts by sum, tags by sorted union."""
    tags = F.array_sort(F.array_union(F.coalesce("l.tags", F.array().cast("array<string>")), F.coalesce("r.tags", F.array().cast("array<string>"))))
    return pairs.select("id", F.greatest("l.salience", "r.salience").alias("salience"), (F.coalesce("l.frequency", F.lit(0)) + F.coalesce("r.frequency", F.lit(0))).alias("frequency"), tags.alias("tags"))


def superseded_updates(changes: DataFrame) -> DataFrame:
    """Receipts of pending updates that a newer pending update of the entity makes needless.

    ``changes(receipt_id, sequence, entity_type, entity_id, operation, synced)``.
    """
    pending = changes.where("operation = 'update' AND NOT synced")
    newest = pending.groupBy("entity_type", "entity_id").agg(F.max("sequence").alias("newest"))
    return pending.join(newest, ["entity_type", "entity_id"]).where("sequence < newest").select("receipt_id")
