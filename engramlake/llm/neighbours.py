"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors go to cells around centroids (fitted on a bounded sample; every vector is
indexed).  Within a cell a vector is its residual to the cell's centre, randomly rotated
and cut to one bit a coordinate, with two correction scalars: the length of the residual
and its inner product with the code.  A query's rotated residual is quantised to four
bits, so an inner product is a few AND-and-count operations on packed words.  The
estimate is unbiased and has a known error bound; only vectors whose upper bound reaches
the least cosine, and the k-th best lower bound, are compared exactly.

Copies of one vector are one entry with the smallest ids of its holders, so a group of
copies of any size costs one entry.  Cells of any size are split: data into blocks,
queries into runs, one unit of work for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.runtime import cut, spread

#: Vectors of a cell that the number of centroids aims at.
PER_CELL = 800
#: Sampled vectors for each centroid, and the sample in all, at most: 100 MB at 64 coordinates.
#: The number of centroids follows the collection up to ``SAMPLE / PER_CENTROID`` (27 million
#: vectors; a broadcast of 8 MB); beyond that cells grow and are split into blocks.
PER_CENTROID, SAMPLE = 12, 400_000
LEAST_SAMPLE = 24_000
#: Centroids that are fitted as one; more are fitted group by group.
FITTED = 2048
#: Salts of the copies of one vector.
SALTS = 16
#: Cells that hold a vector, and cells that are searched for it.
HOLD, SEARCH = 2, 10
#: Data and queries of a unit of work, at most (in the mean; salts are hashes).
DATA_BLOCK, QUERY_RUN = 8192, 65_536
#: Width of the error bound in standard deviations.
EPSILON = 2.6


def usable(embedding: Column, dim: int) -> Column:
    """``dim`` numbers, none null, NaN or infinite, not all zero."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(embedding) == dim) & ~odd & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one, in doubles, of a column of packed vectors (floats or doubles)."""
    rows = column.to_pylist()
    kind = np.float32 if rows and len(rows[0]) == 4 * dim else np.float64
    raw = np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)  # neither overflow nor underflow
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; an empty cell takes a new start.

    More than ``FITTED`` centroids come from groups of the sample, each with its share of them.
    """
    rng = np.random.default_rng(11)
    x = sample.astype(np.float32)
    if cells > FITTED:
        coarse = fit_centroids(x[rng.permutation(len(x))[: 48 * FITTED // 8]], FITTED // 8, rounds)
        own = np.concatenate([np.argmax(x[i : i + 4096] @ coarse.T, axis=1) for i in range(0, len(x), 4096)])
        sizes = np.bincount(own, minlength=len(coarse))
        share = np.minimum(np.maximum(1, np.rint(sizes * cells / len(x))).astype(int), np.maximum(sizes, 1))
        return np.concatenate([fit_centroids(x[own == g], int(k), rounds) for g, k in enumerate(share) if sizes[g]])
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        empty = size < 1e-6
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1), 1e-9)[:, None]
    return c


class Codes:
    """One-bit codes of the vectors of a block, and their search."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.dim = vectors.shape[1]
        self.turn = rotation(self.dim)
        self.centre = vectors.mean(0).astype(np.float32)
        r = (vectors.astype(np.float32) - self.centre) @ self.turn.T
        self.length = np.linalg.norm(r, axis=1)
        safe = np.maximum(self.length, 1e-12)
        self.fit = np.maximum(np.abs(r).sum(1) / (np.sqrt(self.dim) * safe), 1e-3)
        pad = -self.dim % 64
        self.bits = np.packbits(np.pad(r > 0, ((0, 0), (0, pad))), axis=1).view(np.uint64).T.copy()
        self.ones = np.bitwise_count(self.bits).sum(0, dtype=np.int32).astype(np.float32)
        self.spread = (EPSILON * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(self.dim - 1, 1))).astype(np.float32)
        self.pad = pad

    def search(self, queries: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query row, data row, cosine)`` of the pairs that may be among a query's ``k`` best."""
        root = np.float32(np.sqrt(self.dim))
        q = (queries.astype(np.float32) - self.centre) @ self.turn.T
        norm = np.maximum(np.linalg.norm(q, axis=1), 1e-12)
        low, high = q.min(1), q.max(1)
        step = np.maximum((high - low) / 15, 1e-12)
        level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
        dot = np.zeros((len(q), self.bits.shape[1]), np.uint16)
        for j in range(4):
            plane = np.packbits(np.pad(level >> j & 1, ((0, 0), (0, self.pad))), axis=1).view(np.uint64)
            for w in range(plane.shape[1]):
                dot += np.bitwise_count(plane[:, w][:, None] & self.bits[w][None, :]).astype(np.uint16) << np.uint16(j)
        inner = dot.astype(np.float32) * (2 * step)[:, None]
        inner += (2 * low)[:, None] * self.ones[None, :]
        inner -= q.sum(1)[:, None]
        inner *= (self.length / (root * self.fit))[None, :]  # |r| |q| times the estimated cosine of the residuals
        inner += ((2 - self.length[None, :] ** 2) - (norm**2)[:, None]) / 2  # the cosine of unit vectors
        error = (self.length * self.spread)[None, :] * norm[:, None]
        error += (step * root / 2)[:, None] * 0.25  # quantising the query
        upper = inner + error
        floor = np.full(len(q), least - 1e-6, np.float32)
        many = (upper >= floor[:, None]).sum(1)
        for i in np.flatnonzero(many > 8 * k + 32):
            lower = inner[i] - error[i]
            floor[i] = max(floor[i], np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1])  # one may be the query itself
        x, y = np.nonzero(upper >= floor[:, None])
        cos = np.empty(len(x))
        for s in range(0, len(x), 100_000):
            cos[s : s + 100_000] = np.einsum("ij,ij->i", queries[x[s : s + 100_000]], self.exact[y[s : s + 100_000]])
        good = cos >= least
        return x[good], y[good], cos[good]


def _best(ids: np.ndarray, owner: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's ``k`` highest cosines, equal ones by smaller id."""
    order = np.lexsort((ids[other], -cos, owner))
    owner = owner[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return order[rank < k]


def _search_units(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, data first: one block of data is held, queries stream by."""
    unit, parts, codes, names = None, [], None, None
    for batch in batches:
        unit_col = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        data = batch.column(3).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((unit_col[1:] != unit_col[:-1]).any(1) | (data[1:] != data[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(data)]):
            if a == b:
                continue
            if tuple(unit_col[a]) != unit:
                unit, parts, codes = tuple(unit_col[a]), [], None
            part = batch.slice(a, b - a)
            if data[a]:
                parts.append(part)
                codes = None
                continue
            if not parts:
                continue
            if codes is None:
                names = np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts])
                codes = Codes(np.concatenate([_matrix(p.column(5), dim) for p in parts]))
            ids, queries = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5), dim)
            size = max(16, 2_000_000 // len(names))
            for s in range(0, len(ids), size):
                x, y, cos = codes.search(queries[s : s + size], least, k)
                other = ids[s : s + size][x] != names[y]
                x, y, cos = x[other], y[other], cos[other]
                keep = _best(names, x, y, cos, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s : s + size][x[keep]], pa.string()), pa.array(names[y[keep]], pa.string()), pa.array(cos[keep])], names=["rep", "other", "cos"]
                )


def nearest(entries: DataFrame, *, dim: int, k: int, least: float) -> DataFrame:
    """``(rep, other, cos)``: for every entry the ``k`` others with the highest cosine of at least ``least``.

    ``entries(rep string, unit binary)`` holds distinct vectors as packed floats or doubles,
    of any length but zero.  Recall is measured in the tests.
    """
    spark = entries.sparkSession
    total = entries.count()
    cells = int(max(1, min(SAMPLE // PER_CENTROID, total // PER_CELL)))
    if cells <= SEARCH:  # every cell would be searched
        cells, centroids = 1, np.zeros((1, dim), np.float32)
    else:
        # the rows with the smallest hashes: a random sample that does not depend on partitioning
        wanted = max(LEAST_SAMPLE, cells * PER_CENTROID)
        low = F.col("_h") <= int((4 * wanted / total - 1) * (1 << 63)) if wanted * 2 < total else F.lit(True)  # twice as many as wanted, no full sort
        drawn = entries.select("unit", "rep", F.xxhash64("rep").alias("_h")).where(low).orderBy("_h", "rep").limit(wanted)
        centroids = fit_centroids(_matrix(pa.array([bytes(r.unit) for r in drawn.select("unit").collect()], pa.binary()), dim), cells)  # at most SAMPLE rows
        cells = len(centroids)
    shared = spark.sparkContext.broadcast(centroids)
    hold, search = min(HOLD, cells), min(SEARCH, cells)
    chunk = max(64, min(2048, (1 << 23) // cells))  # rows that are ranked at once

    def ranked(units: np.ndarray) -> np.ndarray:
        near = units.astype(np.float32) @ shared.value.T
        if search == near.shape[1]:
            return np.argsort(-near, axis=1, kind="stable")
        top = np.argpartition(-near, search - 1, axis=1)[:, :search]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, chunk):
                near = ranked(_matrix(batch.column(1).slice(s, chunk), dim))
                held += np.bincount(near[:, :hold].ravel(), minlength=cells)
                asked += np.bincount(near.ravel(), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(held), pa.array(asked)], names=["cell", "held", "asked"])

    blocks, runs = np.ones(cells, np.int64), np.ones(cells, np.int64)
    work = spread(entries.select("rep", "unit"), "rep")
    for r in work.mapInArrow(tally, "cell bigint, held bigint, asked bigint").groupBy("cell").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).collect():  # one row a cell
        blocks[r.cell], runs[r.cell] = max(1, -(-r.held // DATA_BLOCK)), max(1, -(-r.asked // QUERY_RUN))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for s in range(0, batch.num_rows, chunk):
                part = batch.slice(s, chunk)
                near = ranked(_matrix(part.column(1), dim))
                salt = np.array([xxh64_intdigest(x) >> 1 for x in part.column(0).to_pylist()], np.int64)
                row, cell, block, run, data = [], [], [], [], []
                for at in range(search):
                    c = near[:, at]
                    # a query visits every block of the cell, in its run
                    times = blocks[c]
                    i = np.repeat(np.arange(len(c)), times)
                    row.append(i)
                    cell.append(c[i])
                    block.append(np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times))
                    run.append((salt // 7919 % runs[c])[i])
                    data.append(np.zeros(len(i), bool))
                    if at < hold:
                        times = runs[c]
                        i = np.repeat(np.arange(len(c)), times)
                        row.append(i)
                        cell.append(c[i])
                        block.append((salt % blocks[c])[i])
                        run.append(np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times))
                        data.append(np.ones(len(i), bool))
                i = np.concatenate(row)
                for a in range(0, len(i), 20_000):
                    z = slice(a, a + 20_000)
                    at = pa.array(i[z])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(cell)[z]), pa.array(np.concatenate(block)[z]), pa.array(np.concatenate(run)[z]), pa.array(np.concatenate(data)[z]), pc.take(part.column(0), at), pc.take(part.column(1), at)],
                        names=["cell", "block", "run", "data", "rep", "unit"],
                    )

    placed = work.mapInArrow(assign, "cell bigint, block bigint, run bigint, data boolean, rep string, unit binary")
    parts = spark.sparkContext.defaultParallelism * 6
    sorted_units = placed.repartition(parts, "cell", "block", "run").sortWithinPartitions("cell", "block", "run", F.desc("data"))
    found = sorted_units.mapInArrow(lambda b: _search_units(b, dim, k, least), "rep string, other string, cos double")
    once = found.groupBy("rep", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cos"), "other"))
    return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def neighbour_lists(neurons: DataFrame, *, dim: int = 64, k: int = 5, least: float = 0.85) -> DataFrame:
    """``(id, other, cos)``: each neuron's ``k`` highest cosines of at least ``least``.

    ``neurons(id, embedding array<float>)``.  Vectors that are null, empty, of another
    length, all zero or with NaN, infinite or null numbers take no part; a neuron written
    more than once counts once (copies that differ: the one with the smallest hash).
    Equal cosines go by smaller id.  An empty input gives no rows.
    """
    good = neurons.where("id IS NOT NULL").where(usable(F.col("embedding"), dim)).select("id", "embedding")
    one = good.groupBy("id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    kind = np.float32 if dict(neurons.dtypes)["embedding"] == "array<float>" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind) + kind(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in raw], pa.binary())], names=["id", "unit"])

    units = cut(one.mapInArrow(pack, "id string, unit binary"))
    # the k + 1 smallest holders of every vector; row_number is limited before the shuffle
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("id"))
    first = units.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy("unit").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = cut(first.select(F.col("ids")[0].alias("rep"), "ids", "unit"))
    lists = nearest(groups.select("rep", "unit"), dim=dim, k=k, least=least)
    held = groups.select("rep", "ids")
    # all copies of one vector under one key would be one task: the key has a salt
    several = groups.where(F.size("ids") > 1).select("rep", "ids", "unit", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copied = units.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(several, ["unit", "salt"])
    own = copied.select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cos")).where("id <> other")
    members = held.where(F.size("ids") <= k).select("rep", F.explode("ids").alias("id"))  # larger groups fill their lists alone
    across = lists.join(held.select(F.col("rep").alias("other"), F.slice("ids", 1, k).alias("ids")), "other").select("rep", "cos", F.explode("ids").alias("other"))
    listed = members.join(across, "rep").select("id", "other", "cos").unionByName(own)
    order = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return listed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def neighbour_pairs(neurons: DataFrame, **options) -> DataFrame:
    """``(neuron_a, neuron_b)``, smaller id first: pairs of which one is in the other's list."""
    lists = neighbour_lists(neurons, **options)
    return lists.select(F.least("id", "other").alias("neuron_a"), F.greatest("id", "other").alias("neuron_b")).distinct()
