"""Smaller passes: merged snapshots, stale priors, priming rates, narratives, cells of key-value texts, chart kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators.merging import fingerprint
from engramlake.operators.scans import top

# Endings that words of one stem differ by.
SUFFIXES = ("tion", "ment", "ing", "ed", "er", "ity", "ness", "ize", "ise", "ate")


def _marks(neurons: DataFrame, end: str) -> DataFrame:
    return neurons.select(F.col("id").alias(end), fingerprint().alias(f"{end}_mark"))


def merge_edges(left: DataFrame, right: DataFrame, neurons: DataFrame) -> DataFrame:
    """``(triple, id, from)``: the edges of two snapshots by what their ends are, and their type.

    Edges with the same triple are one: the left snapshot's with the smallest id, else the
    right one's.  Edges with an end that no neuron has are left out.
    """
    source, target = _marks(neurons, "source_id"), _marks(neurons, "target_id")

    def triples(edges: DataFrame, name: str) -> DataFrame:
        both = edges.select("id", "source_id", "target_id", "type").join(source, "source_id").join(target, "target_id")
        return both.groupBy(F.sha2(F.concat_ws("|", "source_id_mark", "type", "target_id_mark"), 256).alias("triple")).agg(F.min("id").alias(name))

    both = triples(left, "l").join(triples(right, "r"), "triple", "full")
    return both.select("triple", F.coalesce("l", "r").alias("id"), F.when(F.col("l").isNotNull(), "left").otherwise("right").alias("from"))


def merge_fiber_sets(left: DataFrame, right: DataFrame, members: DataFrame, neurons: DataFrame) -> DataFrame:
    """``(members, id, from)``: the fibers of two snapshots by the set of what their members are; ``members(fiber_id, neuron_id)``."""
    said = members.join(_marks(neurons, "neuron_id"), "neuron_id")
    sets = said.groupBy("fiber_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("neuron_id_mark")), "|"), 256).alias("members"))  # members of one fiber
    first = lambda rows, name: rows.select(F.col("id").alias("fiber_id")).join(sets, "fiber_id").groupBy("members").agg(F.min("fiber_id").alias(name))
    both = first(left, "l").join(first(right, "r"), "members", "full")
    return both.select("members", F.coalesce("l", "r").alias("id"), F.when(F.col("l").isNotNull(), "left").otherwise("right").alias("from"))


def stale_priors(priors: DataFrame, *, now, days: int = 30, factor: float = 0.9) -> DataFrame:
    """``(arm, alpha, beta, keep)``: priors not updated for ``days``, drawn towards the uniform one.

    ``priors(arm, alpha, beta, queries, updated)``; one that is nearly uniform after few
    queries is not kept.
    """
    old = priors.where(F.col("updated") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
    a, b = (F.greatest(F.lit(1.0), F.col(c) * factor) for c in ("alpha", "beta"))
    uniform = (a < 1.1) & (b < 1.1) & (F.col("queries") < 3)
    return old.select("arm", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"), (~uniform).alias("keep"))


def aggressiveness(hits: Column, primed: Column) -> Column:
    """How much more or less to prime after so many hits of so many primed nodes."""
    rate = hits / primed
    return F.when(primed < 10, 1.0).when(rate > 0.3, F.least(F.lit(1.5), 1 + rate - 0.3)).when(rate < 0.1, F.greatest(F.lit(0.5), 1 - (0.1 - rate) * 5)).otherwise(1.0)


def chart_kind(points: Column, dated: Column, numbers: Column) -> Column:
    """The chart that suits so many data points, of which some have dates and some numbers."""
    return F.when(points == 0, "table").when((dated > 0) & (numbers > 0), "line").when((numbers > 0) & (points <= 6), "pie").when(numbers > 0, "bar").otherwise("table")


def granularity(start: Column, end: Column) -> Column:
    """The unit that suits a time range."""
    s = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.when(s <= 3600, "minute").when(s <= 86_400, "hour").when(s <= 604_800, "day").when(s <= 2_678_400, "week").when(s <= 31_536_000, "month").otherwise("year")


def stem(word: Column) -> Column:
    """A word without the first of ``SUFFIXES`` it ends in, if three letters are left; else null."""
    out = None
    for s in SUFFIXES:
        good = F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 3)
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when(good, cut) if out is None else out.when(good, cut)
    return out


def expand_stems(words: Column) -> Column:
    """Words, short ones with the first ending added, and the stems of those with an ending; distinct."""
    longer = F.transform(F.filter(words, lambda w: F.length(w).between(3, 6)), lambda w: F.concat(w, F.lit(SUFFIXES[0])))
    return F.array_distinct(F.concat(words, longer, F.array_compact(F.transform(words, stem))))


def cells(docs: DataFrame, *, most: int = 50) -> DataFrame:
    """``(doc_id, cell, weight)``: the ``name: value`` lines of texts that mostly consist of them, as cells.

    At most ``most`` cells a text, the first ones, so that a table is no flood of nodes.
    """
    pair = r"^\s*([\w .-]{1,40})[:=]\s*(\S.*?)\s*$"

    def found(lines: Column) -> Column:
        pairs = F.filter(lines, lambda x: x.rlike(pair))
        good = (F.size(lines) > 1) & (F.size(pairs) * 2 > F.size(lines))
        return F.when(good, F.slice(F.transform(pairs, lambda x: F.concat(F.trim(F.regexp_extract(x, pair, 1)), F.lit(" = "), F.regexp_extract(x, pair, 2))), 1, most))

    lines = F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    rows = docs.where("text IS NOT NULL").select("doc_id", F.transform(F.array(lines), found)[0].alias("c"))
    return rows.select("doc_id", F.explode("c").alias("cell")).distinct().withColumn("weight", F.lit(0.8))


def narratives(fibers: DataFrame, tags: DataFrame, *, k: int = 20) -> DataFrame:
    """``(tag, fibers, markdown)``: the most salient summaries of each topic, in their order of time."""
    said = tags.join(fibers.where("summary IS NOT NULL").select(F.col("id").alias("fiber_id"), "summary", F.coalesce("salience", F.lit(0.0)).alias("s"), "created_at"), "fiber_id")
    best = top(said, ["tag"], [F.desc("s"), "fiber_id"], k)
    lines = F.array_sort(F.collect_list(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "fiber_id", "summary")))  # at most k a tag
    text = F.concat(F.lit("# "), F.col("tag"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["summary"])), "\n"))
    return best.groupBy("tag").agg(lines.alias("lines"), F.count("*").alias("fibers")).select("tag", "fibers", text.alias("markdown"))
