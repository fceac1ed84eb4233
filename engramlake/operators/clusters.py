"""Clusters, drift, interference and similarity of tag and member sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.graph import components
from engramlake.runtime import cut, ship


#: Sets of an item's block in the join of similar sets.
SPLIT = 8192


def set_similarity(rows: DataFrame, *, threshold: float) -> DataFrame:
    """``(a, b, jaccard)`` of ``(set_id, item)`` rows: pairs of sets that reach the threshold, exact.

    Equal sets are one entry.  Items are ordered rarest first and a set meets others only
    under the items of its prefix, so a common item leads to pairs only of sets that hold
    nothing rarer; an item with more than ``SPLIT`` such sets is many units of work, one a
    block of them.  The result holds the smallest id of each distinct set;
    ``set_classes`` gives the ids of a set.
    """
    classes = set_classes(rows)
    reps = classes.groupBy("key").agg(F.min("set_id").alias("set_id"), F.first("n").alias("n"), F.first("items").alias("items"))
    reps = cut(reps.select("set_id", "n", "items"))
    df = reps.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    order = reps.select("set_id", "n", F.explode("items").alias("item")).join(df, "item").groupBy("set_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("o"))
    length = (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    prefix = order.select("set_id", "n", F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(1), length))).alias("item"))
    many = prefix.groupBy("item").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("blocks")).where("blocks > 1")
    placed = prefix.join(many, "item", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = placed.withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    each = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = one.alias("x").join(each.alias("y"), (F.col("x.item") == F.col("y.item")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.set_id") < F.col("y.set_id")))
    pair = pair.where((F.col("x.n") >= threshold * F.col("y.n") - 1e-9) & (F.col("y.n") >= threshold * F.col("x.n") - 1e-9)).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    left, right = reps.select(F.col("set_id").alias("a"), F.col("items").alias("p")), reps.select(F.col("set_id").alias("b"), F.col("items").alias("q"))
    both = F.size(F.array_intersect("p", "q"))
    full = pair.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("p") + F.size("q") - both)).alias("jaccard"))
    return full.where(F.col("jaccard") >= threshold - 1e-12)


#: Sets of a group, pairs that a unit counts at a time, and the share of sets from which an item is a column of the product.
GROUP, CELLS, FREQUENT = 32768, 1 << 22, 0.02


def text_set_similarity(rows: DataFrame, *, threshold: float) -> DataFrame:
    """The rows of ``set_similarity``, for sets of words: large ones, most of which share something.

    There nearly every pair meets under some item of the prefixes at a low threshold, so a
    row for each meeting is more than a comparison of all.  Sets are put into groups and a
    unit of work has two of them: frequent items are counted by a product of matrices, the
    others by their postings.  Only pairs that reach the threshold become rows.  Items are
    compared by 64-bit hashes.
    """
    spark = rows.sparkSession
    ship(spark)
    classes = set_classes(rows).select("set_id", "key", F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    reps = cut(classes.groupBy("key").agg(F.min("set_id").alias("set_id"), F.first("items").alias("items")).select("set_id", "items"))
    n = reps.count()
    groups = max(1, min(8, n // 500), math.ceil(n / GROUP))
    placed = reps.withColumn("own", F.pmod(F.xxhash64("set_id"), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    unit = (F.least("own", "other") * groups + F.greatest("own", "other")).cast("int")
    parts = min(groups * (groups + 1) // 2, max(6 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = reps.schema["set_id"].dataType.simpleString()
    near = placed.select(unit.alias("unit"), "own", "set_id", "items").repartition(parts, "unit").groupBy("unit").applyInArrow(lambda t: _similar_in_unit(t, groups, threshold), f"x {kind}, y {kind}, jaccard double")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _similar_in_unit(table: pa.Table, groups: int, threshold: float) -> pa.Table:
    """``(x, y, jaccard)`` of the pairs of two groups, or of one group with itself."""
    one, two = divmod(table.column("unit")[0].as_py(), groups)
    ids, items = table.column("set_id").combine_chunks(), table.column("items").combine_chunks()
    own, size = table.column("own").to_numpy(), items.value_lengths().to_numpy()
    left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
    item = np.unique(items.flatten().to_numpy(), return_inverse=True)[1]
    row, most = np.repeat(np.arange(len(own)), size), int(item.max(initial=-1)) + 1
    place = np.full(len(own), -1)
    place[right] = np.arange(len(right))
    mine = place[row] >= 0
    order = np.argsort(item[mine], kind="stable")
    posting, df = place[row[mine]][order], np.bincount(item[mine], minlength=most)
    start = np.cumsum(df) - df
    frequent = np.flatnonzero(df > max(1, FREQUENT * len(right)))
    column = np.full(most, -1)
    column[frequent] = np.arange(len(frequent))
    hold = np.zeros((len(frequent), len(right)), np.float32)
    often = column[item] >= 0
    hold[column[item[mine & often]], place[row[mine & often]]] = 1
    ends, found, step = np.cumsum(size), [], max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        batch = left[at : at + step]
        length = size[batch]
        i = np.repeat(np.arange(len(batch)), length)
        k = item[np.arange(length.sum()) + np.repeat(ends[batch] - np.cumsum(length), length)]
        of = column[k] >= 0
        asked = np.zeros((len(batch), len(frequent)), np.float32)
        asked[i[of], column[k[of]]] = 1
        shared = (asked @ hold).ravel()
        i, k = i[~of], k[~of]
        count = df[k]
        cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(count), np.arange(CELLS, count.sum(), CELLS)), len(k)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = count[a:b]
            cell = posting[np.arange(c.sum()) + np.repeat(start[k[a:b]] - (np.cumsum(c) - c), c)] + np.repeat(i[a:b] * len(right), c)
            shared += np.bincount(cell, minlength=len(shared))
        both = shared.reshape(len(batch), -1)
        x, y = np.nonzero(both * (1 + threshold) >= (1 - 1e-6) * threshold * (length[:, None] + size[right][None]).astype(np.float32) - 0.01)  # in 32 bits
        both, x, y = both[x, y].astype(np.float64), batch[x], right[y]
        jaccard = both / (size[x] + size[y] - both)
        good = (jaccard >= threshold - 1e-12) & ((one != two) | (x < y))
        found.append((x[good], y[good], jaccard[good]))
    x, y, jaccard = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y)), "jaccard": jaccard})


def set_classes(rows: DataFrame) -> DataFrame:
    """``(set_id, key, n, items)``: sets with equal items have equal keys."""
    sets = rows.where("set_id IS NOT NULL AND item IS NOT NULL").groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.select("set_id", F.sha2(F.array_join("items", "\x1f"), 256).alias("key"), F.size("items").alias("n"), "items")


def tag_clusters(tag_pairs: DataFrame, tag_counts: DataFrame, *, least_pairs: int = 3, link: float = 0.4) -> DataFrame:
    """``(tag, canonical)``: tags that go together, named by the most used of them.

    ``tag_pairs(a, b, n)``, ``tag_counts(tag, fibers)``.
    """
    c = tag_counts
    pair = tag_pairs.where(F.col("n") >= least_pairs).join(c.select(F.col("tag").alias("a"), F.col("fibers").alias("fa")), "a").join(c.select(F.col("tag").alias("b"), F.col("fibers").alias("fb")), "b")
    near = pair.where(F.col("n") / (F.col("fa") + F.col("fb") - F.col("n")) >= link).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    label = components(near).join(c, F.col("node") == F.col("tag")).select("tag", "component", "fibers")
    best = label.groupBy("component").agg(F.max(F.struct("fibers", "tag")).alias("m"))
    return label.join(best, "component").select("tag", F.col("m.tag").alias("canonical"))


def fan_effect(tags: DataFrame, *, least: int = 15) -> DataFrame:
    """Tags that hold so many fibers that they interfere."""
    return tags.groupBy("tag").agg(F.countDistinct("fiber_id").alias("fan")).where(F.col("fan") >= least)


def merge_fibers(members: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``(fiber_id, merged_into)``: fibers with similar members, by connected components."""
    sets = members.select(F.col("fiber_id").alias("set_id"), F.col("neuron_id").alias("item"))
    near = set_similarity(sets, threshold=threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    classes = set_classes(sets)
    first = classes.groupBy("key").agg(F.min("set_id").alias("rep"))
    label = components(near).select(F.col("node").alias("rep"), "component")
    return classes.join(first, "key").join(label, "rep", "left").select(F.col("set_id").alias("fiber_id"), F.coalesce("component", "rep").alias("merged_into"))


def common_subsequence(pairs: DataFrame) -> DataFrame:
    """``(id, length)``: longest common subsequence of two arrays of text, ``pairs(id, a, b)``."""

    @F.pandas_udf("int")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> int:
            last = [0] * (len(y) + 1)
            for item in x:
                now = [0]
                for j, other in enumerate(y):
                    now.append(last[j] + 1 if item == other else max(last[j + 1], now[j]))
                last = now
            return last[-1]

        return pd.Series([0 if x is None or y is None else one(x, y) for x, y in zip(a, b)])

    return pairs.select("id", length("a", "b").alias("length"))
