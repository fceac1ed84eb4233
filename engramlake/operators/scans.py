"""Scans, point lookups and predicates over the graph tables.

Keys of a batch are DataFrames or short lists; a list becomes an ``IN`` predicate that is
pushed to the scan.  Repeated rows of a table count once (``unique``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.runtime import cut, ship


def unique(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row a key; copies of a row are equal, so any of them."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def by_ids(rows: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    """Rows with one of the ids; unknown ids are silently left out."""
    return rows.where(F.col(key).isin(list(ids)))


def find_neurons(neurons: DataFrame, *, type: str | None = None, contains: str | None = None, exact: str | None = None, since=None, until=None, ephemeral: bool | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Conjunctive scan in id order; bounds of time are inclusive, containment ignores case."""
    out = neurons
    for given, test in (
        (type, F.col("type") == type), (exact, F.col("content") == exact), (ephemeral, F.col("ephemeral") == ephemeral),
        (since, F.col("created_at") >= F.lit(since).cast("timestamp_ntz")), (until, F.col("created_at") <= F.lit(until).cast("timestamp_ntz")),
    ):
        out = out if given is None else out.where(test)
    if contains is not None:
        out = out.where(F.lower("content").contains(contains.lower()))
    if limit is None:
        return out
    return out.orderBy("id").offset(offset).limit(min(limit, 1000 if contains or exact else 10_000))


def match_tokens(rows: DataFrame, query: str, *, key: str = "id", text: str = "content") -> DataFrame:
    """Rows that hold every token of the query, in any script; a query without tokens matches none."""
    wanted = S.search_tokens(F.lit(query))
    return rows.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, S.search_tokens(F.col(text)))) == 0))


def bm25(rows: DataFrame, queries: DataFrame, *, key: str = "id", text: str = "content", k: int = 10, k1: float = 1.2, b: float = 0.75, least_chars: int = 25) -> DataFrame:
    """``(query_id, key, score, rank)``: ranked full-text search for many queries at once.

    ``queries(query_id, query)``.  Statistics cover all rows with at least
    ``least_chars`` characters.  Only postings of the queries' words are joined.  Ties go
    by key.  Scores are rounded to 9 decimals before ranking.
    """
    docs = rows.where(F.length(text) >= least_chars).select(F.col(key).alias("doc"), S.search_tokens(F.col(text)).alias("words"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(S.search_tokens(F.col("query")))).alias("word"))
    hits = docs.select("doc", F.size("words").alias("len"), F.explode("words").alias("word")).join(F.broadcast(wanted.select("word").distinct()) if wanted.limit(10_001).count() <= 10_000 else wanted.select("word").distinct(), "word", "left_semi")
    tf = hits.groupBy("word", "doc", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, "word").join(F.broadcast(stats)).select("word", "doc", weight.alias("w")).join(wanted, "word").groupBy("query_id", "doc").agg(F.round(F.sum("w"), 9).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), "doc"], k).withColumnRenamed("doc", key)


def top(rows: DataFrame, groups: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; limited before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def page_after(rows: DataFrame, cursor: str | None, *, limit: int = 1000, key: str = "id") -> DataFrame:
    """The next page in key order."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(limit)


def exact_batch(neurons: DataFrame, contents: Sequence[str]) -> DataFrame:
    """One neuron (smallest id) for each content."""
    return neurons.where(F.col("content").isin(list(contents))).groupBy("content").agg(F.min("id").alias("id"))


def suggest(neurons: DataFrame, states: DataFrame, fragment: str, *, k: int = 5) -> DataFrame:
    """Autocomplete: contents that contain the fragment, by use and activation."""
    near = neurons.where(F.lower("content").contains(fragment.lower())).join(states, F.col("id") == F.col("neuron_id"), "left")
    score = F.round(0.1 * F.coalesce("access_frequency", F.lit(0)) + 0.5 * F.coalesce("activation_level", F.lit(0.0)), 6)
    return near.select("id", "content", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def neuron_states(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """State of every neuron from its edges: level, uses, last use."""
    ends = synapses.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("neuron_id"), "weight", "reinforced_count", "last_activated")
    used = ends.groupBy("neuron_id").agg(
        F.round(F.max("weight"), 6).alias("activation_level"), F.sum(F.coalesce("reinforced_count", F.lit(0))).alias("access_frequency"), F.max("last_activated").alias("last_activated")
    )
    return neurons.select(F.col("id").alias("neuron_id")).join(used, "neuron_id", "left").select(
        "neuron_id", F.coalesce("activation_level", F.lit(0.0)).alias("activation_level"), F.coalesce("access_frequency", F.lit(0)).cast("bigint").alias("access_frequency"), "last_activated"
    )


def find_synapses(synapses: DataFrame, *, source: str | None = None, target: str | None = None, type: str | None = None, least_weight: float | None = None) -> DataFrame:
    out = synapses
    for given, test in ((source, F.col("source_id") == source), (target, F.col("target_id") == target), (type, F.col("type") == type), (least_weight, F.col("weight") >= F.lit(least_weight))):
        out = out if given is None else out.where(test)
    return out


def adjacency(synapses: DataFrame, ids: Sequence[str], direction: str = "out") -> DataFrame:
    """Edges of each of the ids, one row an edge."""
    end = "source_id" if direction == "out" else "target_id"
    return synapses.where(F.col(end).isin(list(ids))).select(F.col(end).alias("neuron_id"), F.col("id").alias("synapse_id"), "type", "weight")


def tags_of(fibers: DataFrame) -> Column:
    return F.array_union(F.coalesce("auto_tags", F.array().cast("array<string>")), F.coalesce("agent_tags", F.array().cast("array<string>")))


def overlaps(start, end) -> Column:
    """Closed interval overlap as a filter that reaches the scan; a null bound overlaps nothing."""
    return (F.col("time_start") <= F.lit(end).cast("timestamp_ntz")) & (F.col("time_end") >= F.lit(start).cast("timestamp_ntz"))


def valid_at(moment) -> Column:
    """Open bounds are unbounded, a window of no width is unbounded, both ends inclusive."""
    t = F.lit(moment).cast("timestamp_ntz")
    inside = F.coalesce(F.col("time_start") <= t, F.lit(True)) & F.coalesce(F.col("time_end") >= t, F.lit(True))
    return F.when(F.col("time_start") == F.col("time_end"), True).otherwise(inside)


def find_fibers(fibers: DataFrame, *, contains: str | None = None, window: tuple | None = None, tags: Sequence[str] = (), least_salience: float | None = None) -> DataFrame:
    """Fibers with the member, overlapping the window, with all the tags and the salience."""
    out = fibers
    if contains is not None:
        out = out.where(F.array_contains("neuron_ids", contains))
    if window is not None:
        out = out.where(overlaps(*window))
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), tags_of(out))) == 0)
    return out if least_salience is None else out.where(F.col("salience") >= least_salience)


def fibers_of(fibers: DataFrame, ids: Sequence[str], *, per_neuron: int = 10) -> DataFrame:
    """Distinct fibers with any of the ids, most salient first, ``per_neuron`` times the ids at most."""
    return fibers.where(F.arrays_overlap("neuron_ids", F.array(*map(F.lit, ids)))).orderBy(F.desc("salience"), "id").limit(per_neuron * len(ids))


def typed_memories(documents: DataFrame) -> DataFrame:
    """Documents as typed memories: type, priority by type, expiry by type."""
    keep = F.when(F.col("memory_type") == "todo", 30).when(F.col("memory_type") == "context", 7).when(F.col("memory_type") == "error", 90)
    weight = F.when(F.col("memory_type").isin("decision", "instruction"), 8).when(F.col("memory_type").isin("todo", "error"), 7).otherwise(5)
    return documents.select(
        "doc_id", F.coalesce("memory_type", F.lit("fact")).alias("memory_type"), weight.alias("priority"), "brain_id", "created_at",
        (F.col("created_at") + F.make_interval(days=keep)).alias("expires_at"),
    )


def within(rows: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows inside a circle; rows without a place are outside. A latitude band is pushed first."""
    band = radius_m / 111_000
    near = rows.where(F.col("lat").between(lat - band, lat + band))
    return near.where(S.haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_m)


def usable(vector: str, size: int) -> Column:
    """``size`` numbers, none NaN, not all zero."""
    return (F.size(vector) == size) & ~F.exists(vector, lambda x: F.isnan(x)) & F.exists(vector, lambda x: x != 0)


def dedup_ladder(neurons: DataFrame, queries: DataFrame, *, size: int = 64, same: float = 0.85, other: float = 0.75) -> DataFrame:
    """``(id, other, similarity, verdict)``: for each query the nearest of all other neurons, and what that says.

    ``queries(id, embedding)`` is a stated small set (at most 1,000 rows); it is broadcast.
    ``duplicate`` at ``same`` or more, ``distinct`` below ``other``, else ``undecided``.
    """
    if queries.limit(1001).count() > 1000:
        raise ValueError("at most 1,000 queries")
    asked = F.broadcast(queries.select("id", F.col("embedding").alias("q")))
    rows = neurons.where(usable("embedding", size)).select(F.col("id").alias("other"), "embedding").join(asked, F.col("other") != F.col("id"))
    scored = rows.select("id", "other", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("n"), "other")).alias("m")).select("id", "m.other", (-F.col("m.n")).alias("similarity"))
    verdict = F.when(F.col("similarity") >= same, "duplicate").when(F.col("similarity") < other, "distinct").otherwise("undecided")
    return best.where("similarity > 0").withColumn("verdict", verdict)


def near_hashes(rows: DataFrame, *, limit: int, key: str = "id", value: str = "content_hash") -> DataFrame:
    """``(a, b, distance)``: pairs of different 64-bit hashes within a Hamming distance, each by its smallest id.

    Of four bands of 16 bits one differs in at most ``limit / 4`` bits: exact.  A band's
    values are cut into units by their first bits, more units for more hashes.  A hash is
    sent to its own unit and to those of lower bits that are so few bits away; what differs
    in the other bits is looked up inside the unit, so no row is made for it.  A hash of 0
    or null matches nothing; copies of a hash are one entry.
    """
    if not 0 <= limit < 16:
        raise ValueError("limit is from 0 to 15")
    spark, few = rows.sparkSession, limit // 4
    ship(spark)
    h = cut(rows.where((F.col(value) != 0) & F.col(key).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(key).alias("id")))
    n = h.count()
    first = next(k for k in range(3, 17) if k == 16 or n * (1 + len(_flips(k, few))) / 2 ** (k + 1) <= UNIT)
    lead = [F.shiftrightunsigned("h", 16 * b + 16 - first).bitwiseAND(F.lit((1 << first) - 1)) for b in range(4)]
    asked = h.select("h", F.posexplode(F.array(*lead)).alias("band", "own"))
    sent = asked.select("h", "band", "own", F.explode(F.array(*map(F.lit, _flips(first, few)))).alias("flip")).withColumn("to", F.col("own").bitwiseXOR(F.col("flip"))).where("to <= own")
    sent = sent.select((F.col("band") * (1 << first) + F.col("to")).cast("int").alias("unit"), "h")
    parts = min(4 << first, max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = sent.repartition(parts, "unit").groupBy("unit").applyInArrow(lambda t: _near_in_unit(t, first, limit), "g long, k long, distance int")
    named = near.join(h.select(F.col("h").alias("g"), F.col("id").alias("i")), "g").join(h.select(F.col("h").alias("k"), F.col("id").alias("j")), "k")
    return named.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").distinct()


#: Hashes of a unit, and pairs compared at a time, in the search for near hashes.
UNIT, PAIRS = 4_000_000, 1 << 21


def _flips(width: int, most: int) -> list[int]:
    """Numbers of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << i for i in bits) for r in range(min(width, most) + 1) for bits in combinations(range(width), r)]


def _near_in_unit(table: pa.Table, first: int, limit: int) -> pa.Table:
    """Pairs of a unit in which no earlier band is as near; one has its own band's first bits, the other those or higher ones."""
    few = limit // 4
    band, top = divmod(table.column("unit")[0].as_py(), 1 << first)
    h = table.column("h").to_numpy().view(np.uint64)
    v = (h >> np.uint64(16 * band)).astype(np.int64) & 65535
    order = np.argsort(v, kind="stable")  # the unit's own hashes come first: the others have higher bits
    h, v = h[order], v[order]
    low = top << (16 - first)
    own = int(np.searchsorted(v, low + (1 << (16 - first))))
    starts = np.searchsorted(v[:own], low + np.arange((1 << (16 - first)) + 1))
    found = []
    for flip in _flips(16, few):
        t = v ^ flip
        # a pair inside the unit is met from its lower value, one of equal values from its first row
        at = np.flatnonzero((t >> (16 - first) == top) & ((np.arange(len(v)) >= own) | (t > v) | (flip == 0)))
        t = t[at] - low
        begin, end = starts[t], starts[t + 1]
        if not flip:
            begin = np.where(at < own, at + 1, begin)
        count = end - begin
        some = count > 0
        at, begin, count = at[some], begin[some], count[some]
        if not len(at):
            continue
        ends = np.cumsum(count)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), len(at)])
        for x, y in zip(cuts[:-1], cuts[1:]):
            c = count[x:y]
            i = np.repeat(at[x:y], c)
            j = np.arange(c.sum()) + np.repeat(begin[x:y] - (np.cumsum(c) - c), c)
            differs = h[i] ^ h[j]
            distance = np.bitwise_count(differs)
            good = np.flatnonzero(distance <= limit)
            for b in range(band):  # what an earlier band finds
                good = good[np.bitwise_count(differs[good] >> np.uint64(16 * b) & np.uint64(65535)) > few]
            if len(good):
                found.append((h[i[good]], h[j[good]], distance[good]))
    g, k, distance = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0))
    return pa.table({"g": g.view(np.int64), "k": k.view(np.int64), "distance": distance.astype(np.int32)})


def knn(rows: DataFrame, query: Sequence[float], *, key: str = "id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """Exact nearest vectors of one query; zero and wrong-length vectors are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    good = rows.where((F.size(vector) == len(query)) & ~F.exists(vector, lambda x: F.isnan(x)) & F.exists(vector, lambda x: x != 0))
    return good.select(key, F.round(S.cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
