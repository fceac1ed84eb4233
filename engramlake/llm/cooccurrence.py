"""Items that appear together: pair counts, lift and pointwise mutual information.

Items are deduplicated for each basket, ordered pairs are emitted and their counts
combined map-side; marginals give how much more often than chance.  Items that no
answer can hold are left out before pairs are made: ``n(a,b) <= min(n(a), n(b))``, so an
item below the count floor, or one in more than ``N / min_lift`` baskets, is in no pair
that reaches both bounds.  That is exact, and it is what takes hub items out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.runtime import cut

#: Items of a basket that one row holds when pairs are made; longer baskets are split
#: into blocks and pairs are made block against block, in separate rows.
BLOCK = 256


def memory_baskets(co_activations: DataFrame, fibers: DataFrame) -> DataFrame:
    """``(record, items array<string>)`` of co-activations (two ends) and fibers (members).

    Nulls are dropped, an item counts once for each record, copies of a record are merged
    into one, and only records with at least two different items are kept.  A row without
    an id is no record.
    """
    ends = co_activations.select(F.concat(F.lit("c:"), "id").alias("record"), F.array("neuron_a", "neuron_b").alias("items"))
    members = fibers.select(F.concat(F.lit("f:"), "id").alias("record"), F.col("neuron_ids").alias("items"))
    return baskets(ends.unionByName(members))


def baskets(rows: DataFrame) -> DataFrame:
    """Deduplicated baskets of ``(record, items)`` rows; see ``memory_baskets``."""
    tidy = rows.select("record", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where("record IS NOT NULL AND size(items) > 0")
    merged = tidy.groupBy("record").agg(F.collect_set("items").alias("sets"))
    whole = merged.select("record", F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("sets")))).alias("items"))
    return whole.where(F.size("items") > 1)


def _pairs(grouped: DataFrame) -> DataFrame:
    """Ordered pairs of the sorted ``items`` arrays, block against block."""
    blocks = F.ceil(F.size("items") / F.lit(BLOCK)).cast("int")
    slot = F.explode(F.expr(f"flatten(transform(sequence(0, {'{n}'} - 1), i -> transform(sequence(i, {'{n}'} - 1), j -> named_struct('i', i, 'j', j))))".format(n="blocks")))
    long = grouped.select("items", blocks.alias("blocks")).where("blocks > 1").select("items", slot.alias("s")).select(
        F.slice("items", F.col("s.i") * BLOCK + 1, F.lit(BLOCK)).alias("x"),
        F.slice("items", F.col("s.j") * BLOCK + 1, F.lit(BLOCK)).alias("y"),
    )
    short = grouped.where(F.size("items") <= BLOCK).select(F.col("items").alias("x"), F.col("items").alias("y"))
    return short.unionByName(long).select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).where("a < b")


def cooccurrence(grouped: DataFrame, *, min_count: int = 8, min_lift: float = 10.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, lift, pmi)`` of the pairs that reach both bounds.

    ``grouped`` is what ``baskets`` gives.  ``item_a < item_b``; ``lift`` is ``n_ab * N /
    (n_a * n_b)`` and ``pmi`` its base-2 logarithm.  No baskets give no rows.
    """
    grouped = cut(grouped)
    total = grouped.agg(F.count("*").alias("n")).first()["n"]
    counts = grouped.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    counts = cut(counts.where((F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(float(total)) * (1 + 1e-12))))
    kept = grouped.select("record", F.explode("items").alias("item")).join(counts.select("item"), "item", "left_semi")
    # record is the key of one basket; collect_list holds no more than the basket did
    regrouped = kept.groupBy("record").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    pairs = _pairs(regrouped).groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a = counts.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        pairs.join(a, "a").join(b, "b")
        .select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", lift.alias("lift"), F.log2(lift).alias("pmi"))
        .where(F.col("n_ab") * F.lit(total) >= F.col("n_a") * F.col("n_b") * F.lit(min_lift))
    )
