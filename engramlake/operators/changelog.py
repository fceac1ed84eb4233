"""Commit-ordered replay of a change feed.

A receipt is a transaction.  Its copies are assembled into one (copies that do not
parse count for nothing), transactions are ordered by their lowest sequence, and state
is exposed only up to a watermark.  Changes of different entities do not conflict, so
they replay in parallel; within an entity the replay is an aggregate, not a sort: an
entity is there if its last insert comes after its last delete, and what took effect
since that insert are the inserts and updates with a sequence not below it.  All of it
combines map-side, so an entity or receipt with a third of all rows is reduced before
any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.runtime import cut

#: Sequences of one block of the gap search; only one block is ever looked into.
GAP_BLOCK = 1 << 16
_TEXT = ("brain_id", "entity_type", "entity_id", "operation", "device_id", "changed_at")


def parse_changes(log: DataFrame) -> DataFrame:
    """Flat rows of the whole copies in ``change_log``.

    ``receipt_id, sequence, brain_id, entity_type, entity_id, operation (lower case,
    trimmed), device_id, changed_at, payload (JSON text)``.  Rows whose ``change`` is
    null, cut off or not a JSON object with an entity, a sequence and a receipt are
    dropped.  The flat columns of the log are not read.
    """
    v = F.try_parse_json("change")
    rows = log.select("receipt_id", v.alias("_v")).where("_v IS NOT NULL AND receipt_id IS NOT NULL")
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    flat = rows.select(
        "receipt_id",
        get("sequence", "bigint").alias("sequence"),
        *[get(c, "string").alias(c) for c in _TEXT],
        F.to_json(get("payload", "variant")).alias("payload"),
    )
    return flat.withColumn("operation", F.lower(F.trim("operation"))).where("entity_id IS NOT NULL AND sequence IS NOT NULL")


def synced_receipts(log: DataFrame) -> DataFrame:
    """``(receipt_id, synced)``: whether any whole copy of the receipt says that it was sent."""
    v = F.try_parse_json("change")
    rows = log.select("receipt_id", F.try_variant_get(v, "$.synced", "boolean").alias("synced"), F.try_variant_get(v, "$.entity_id", "string").alias("e"), F.try_variant_get(v, "$.sequence", "bigint").alias("s"))
    return rows.where("receipt_id IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL").groupBy("receipt_id").agg(F.coalesce(F.bool_or("synced"), F.lit(False)).alias("synced"))


def assemble_transactions(changes: DataFrame) -> DataFrame:
    """One row for each receipt, at its lowest sequence.

    Copies that tie at that sequence are told apart by their content, so the choice does
    not depend on row order.
    """
    rest = [c for c in changes.columns if c not in ("receipt_id", "sequence")]
    first = F.min(F.struct("sequence", *rest)).alias("_t")
    return changes.groupBy("receipt_id").agg(first).select("receipt_id", "_t.*")


def committed_watermark(transactions: DataFrame, *, start: int | None = None) -> DataFrame:
    """One row ``(first_sequence, watermark, last_sequence)``: the end of the run without gaps.

    Blocks of sequences are counted first; only the first block that is not full is
    looked into.  An empty input gives one row of nulls.
    """
    seqs = transactions.select("sequence").distinct()
    ends = seqs.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    if start is not None:
        ends = ends.withColumn("lo", F.lit(start).cast("bigint"))
    offset = F.col("sequence") - F.col("lo")
    placed = seqs.join(F.broadcast(ends)).where(offset >= 0).select(offset.alias("off"), "lo", "hi")  # ends is one row
    blocks = placed.groupBy(F.floor(F.col("off") / GAP_BLOCK).alias("b")).agg(F.count("*").alias("n"), F.max("off").alias("top"))
    short = blocks.where(F.col("n") < GAP_BLOCK).agg(F.min("b").alias("short"))
    full = F.broadcast(short)
    part = (
        placed.join(full)
        .where(F.floor(F.col("off") / GAP_BLOCK) == F.col("short"))
        .groupBy("short")
        .agg(F.array_sort(F.collect_list(F.col("off") % GAP_BLOCK)).alias("there"))  # below GAP_BLOCK numbers
        .select("short", F.size(F.filter("there", lambda x, i: x == i)).alias("run"))
    )
    # A block before the first listed short one may be missing altogether.
    listed = blocks.where(F.col("n") == GAP_BLOCK).select("b").union(short.select("short"))
    hole = listed.where("b IS NOT NULL").agg(F.count("*").alias("listed"), F.max("b").alias("most"))
    before = blocks.join(full).where("b < short").agg(F.count("*").alias("full_before"))
    end = F.when(F.col("full_before") < F.col("short"), F.col("full_before") * GAP_BLOCK - 1).otherwise(F.col("short") * GAP_BLOCK + F.coalesce("run", F.lit(0)) - 1)
    return (
        ends.join(F.broadcast(short)).join(F.broadcast(before)).join(F.broadcast(hole)).join(F.broadcast(part.select("run")), how="left")
        .select(F.col("lo").alias("first_sequence"), F.when(F.col("short").isNull(), F.col("hi")).otherwise(F.col("lo") + end).alias("watermark"), F.col("hi").alias("last_sequence"))
    )


def _committed(transactions: DataFrame, gaps: str, through: int | None) -> DataFrame:
    """The transactions that state may show: those up to the committed watermark.

    ``gaps="hold"`` takes the log as still arriving: the watermark is the last sequence before
    the first missing one.  ``gaps="closed"`` takes every number that no receipt has as one that
    will never come, so the watermark is the last sequence there is.  ``through`` lowers it.
    """
    if gaps == "hold":
        mark = committed_watermark(transactions).select("watermark")
    elif gaps == "closed":
        mark = transactions.agg(F.max("sequence").alias("watermark"))
    else:
        raise ValueError(f"gaps is 'closed' or 'hold', not {gaps!r}")
    if through is not None:
        mark = mark.select(F.least("watermark", F.lit(through)).alias("watermark"))
    shown = transactions.join(F.broadcast(mark)).where(F.col("sequence") <= F.col("watermark")).drop("watermark")  # one row
    return shown.where(F.col("operation").isin("insert", "update", "delete"))


def replay(log: DataFrame, *, gaps: str = "closed", through: int | None = None) -> DataFrame:
    """``(entity_type, entity_id, receipt_id, sequence)`` of every entity that is there at the end.

    ``receipt_id`` is the receipt that last took effect on the entity.  Only what lies up to
    the committed watermark is exposed: with ``gaps="hold"`` nothing after the first missing
    sequence, with ``gaps="closed"`` (a complete log, whose missing numbers belong to nothing)
    everything; ``through`` exposes state as of an earlier sequence.  Two receipts at one
    sequence are ordered by receipt id.  Unknown operations do nothing; an empty log gives
    no rows.
    """
    # two uses, the watermark and the replay, of one parse of the log
    transactions = cut(assemble_transactions(parse_changes(log).select("receipt_id", "sequence", "entity_type", "entity_id", "operation")))
    at = F.struct("sequence", "receipt_id")
    op = F.col("operation")
    return (
        _committed(transactions, gaps, through)
        .groupBy("entity_type", "entity_id")
        .agg(
            F.max(F.when(op == "insert", at)).alias("inserted"),
            F.max(F.when(op == "delete", at)).alias("deleted"),
            F.max(F.when(op != "delete", at)).alias("effect"),
        )
        .where("inserted IS NOT NULL AND (deleted IS NULL OR inserted > deleted)")
        .select("entity_type", "entity_id", F.col("effect.receipt_id").alias("receipt_id"), F.col("effect.sequence").alias("sequence"))
    )


def replay_fields(log: DataFrame, *, gaps: str = "closed", through: int | None = None) -> DataFrame:
    """``(entity_type, entity_id, field, value)``: the payload of every entity at the end.

    The insert that put the entity there gives its first fields; each later update sets
    the fields it names.  A payload that is not a JSON object has no fields; an entity
    without fields has no rows here.  ``value`` is text as in ``get_json_object``.  ``gaps``
    and ``through`` are as in ``replay``.
    """
    done = _committed(cut(assemble_transactions(parse_changes(log))), gaps, through)
    at = F.struct("sequence", "receipt_id")
    base = done.groupBy("entity_type", "entity_id").agg(
        F.max(F.when(F.col("operation") == "insert", at)).alias("inserted"), F.max(F.when(F.col("operation") == "delete", at)).alias("deleted")
    )
    alive = base.where("inserted IS NOT NULL AND (deleted IS NULL OR inserted > deleted)").select("entity_type", "entity_id", "inserted")
    fields = done.where("operation <> 'delete'").select(
        "entity_type", "entity_id", at.alias("at"), F.explode(F.from_json("payload", "map<string,string>")).alias("field", "value")
    )
    return (
        fields.join(alive, ["entity_type", "entity_id"])
        .where("at >= inserted")
        .groupBy("entity_type", "entity_id", "field")
        .agg(F.max_by("value", "at").alias("value"))
    )
