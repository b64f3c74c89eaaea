"""Approximate nearest neighbours with a forest of sorted hash strings.

Every row gets one long hash string (random hyperplanes, 60 bits) in each tree; a
tree is the sorted array of its strings.  A query descends every tree to the
longest prefix that some row shares, then all trees ascend together, one bit
at a time, until enough different vectors share the prefix; these candidates,
with all their copies, are scored in single precision, and those within its
error of the k best again in double precision.

The index is cut into blocks of rows by a hash of vec_id and the queries into
blocks too, so a frequent vector or a hot bucket is spread over all blocks and
a task's memory is bounded.  Every index row takes part in every query's
search of its block; the best of each block meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

K, EVERY = 20, 20
TREES, BITS = 64, 60
#: Rows of an index block and of a query block; the index is copied once for each query block.
ROWS, QUERIES = 4096, 32768
#: The trees ascend until the prefixes they share with the query hold this share of the block's different vectors, each counted once (4 k at least).
SHARE = 0.45
#: Bound of the relative error of a score in single precision.
SINGLE = 1e-5


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dim, bits)).astype(np.float32)


def strings(x: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The hash strings of all rows in one tree, as integers whose leading bits are the string's first."""
    bits = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32) @ plane > 0
    return bits @ (np.int64(1) << np.arange(plane.shape[1] - 1, -1, -1, dtype=np.int64))


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.vectors, self.bits, self.planes = vectors, bits, planes(vectors.shape[1], trees, bits)
        self.sorted, self.row = [], []
        for plane in self.planes:
            s = strings(vectors, plane)
            order = np.argsort(s, kind="stable")
            self.sorted.append(s[order])
            self.row.append(order)

    def candidates(self, queries: np.ndarray, wanted: int):
        """(query, rows) of each query: found by descending to the longest prefixes and ascending synchronously to `wanted` different rows, or all there are."""
        wanted = min(wanted, len(self.vectors))
        mine = [strings(queries, plane) for plane in self.planes]

        def spans(depth: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shift = self.bits - depth
            low = [np.searchsorted(s, m[q] >> shift << shift) for s, m in zip(self.sorted, mine, strict=True)]
            high = [np.searchsorted(s, (m[q] >> shift << shift) + (np.int64(1) << shift)) for s, m in zip(self.sorted, mine, strict=True)]
            return np.array(low), np.array(high)

        # each tree's own longest prefix: the deeper of the two neighbours in sorted order
        deepest = np.zeros(len(queries), np.int64)
        for s, m in zip(self.sorted, mine, strict=True):
            at = np.searchsorted(s, m)
            for near in (np.clip(at - 1, 0, len(s) - 1), np.clip(at, 0, len(s) - 1)):
                differ = s[near] ^ m
                shared = np.where(differ == 0, self.bits, self.bits - 1 - np.floor(np.log2(np.maximum(differ, 1))).astype(np.int64))
                deepest = np.maximum(deepest, shared)
        # entries only grow on the way up, so the first depth with enough of them is found by halving; they are never fewer than different rows
        depth, top = np.zeros(len(queries), np.int64), deepest.copy()
        while len(q := np.flatnonzero(depth < top)):
            half = (depth[q] + top[q] + 1) // 2
            low, high = spans(half, q)
            enough = (high - low).sum(axis=0) >= wanted
            depth[q[enough]], top[q[~enough]] = half[enough], half[~enough] - 1
        entries, open_ = np.zeros(len(queries), np.int64), np.ones(len(queries), bool)
        while len(q := np.flatnonzero(open_)):
            low, high = spans(depth[q], q)
            held = (high - low).sum(axis=0)
            for at in np.flatnonzero(held > entries[q]):
                rows = self.rows(low[:, at], high[:, at])
                if len(rows) >= wanted:
                    open_[q[at]] = False
                    yield q[at], rows
            entries[q] = held
            depth -= 1

    def rows(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.vectors), bool)
        for t, row in enumerate(self.row):
            seen[row[low[t] : high[t]]] = True
        return np.flatnonzero(seen)


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, share: float = SHARE):
    """(query id, row ids, scores) of the k nearest candidates of each query, ties to smaller ids."""
    different, which = np.unique(vectors, axis=0, return_inverse=True)  # copies share every string, so they are one entry
    which = which.reshape(-1)
    wanted = max(int(np.ceil(share * len(different))), 4 * k)
    small = (vectors / np.abs(vectors).max()).astype(np.float32)
    long_ = float(np.sqrt((small.astype(np.float64) ** 2).sum(axis=1).max()))
    for q, found in Forest(different).candidates(queries, wanted):
        vector, hit = queries[q], np.zeros(len(different), bool)
        hit[found] = True
        rows = np.flatnonzero(hit[which])
        rows = rows[ids[rows] != query_ids[q]]
        if len(rows) > 4 * k:
            one = vector / np.abs(vector).max()
            rough = np.take(small, rows, axis=0) @ one.astype(np.float32)
            edge = float(np.partition(rough, len(rough) - k)[len(rough) - k])
            rows = rows[rough >= edge - 2 * SINGLE * long_ * float(np.sqrt(one @ one))]
        score = np.array([float(np.dot(vectors[r], vector)) for r in rows])  # one order of summation for every copy of a vector
        order = np.lexsort((ids[rows], -score))[:k]
        yield int(query_ids[q]), ids[rows[order]], score[order]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: no null, zero or non-finite vectors."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearest(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`, by inner product.

    Null, zero and non-finite vectors take no part; with fewer than k other
    rows all are given; a vec_id that repeats counts once per row as a
    candidate but never for its own query; vectors of another length than the
    query's are not compared; an empty table gives no rows; other columns are
    ignored.
    """
    good = usable(rows)
    counts = good.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    blocks, query_blocks = max(1, -(-counts[0] // ROWS)), max(1, -(-counts[1] // QUERIES))
    dim = F.size("v").alias("dim")
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    index = good.select("vec_id", "v", dim, part(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qblock"), F.lit(False).alias("asks"))
    asked = good.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(query_blocks, 2).alias("qblock"), F.lit(True).alias("asks"))
    placed = spread(index.unionByName(asked), "block", "qblock", "dim").sortWithinPartitions("block", "qblock", "dim")

    def run(batches):
        key, ids, asks, parts = None, [], [], []

        def found():
            if not ids:
                return
            who, asking, x = np.concatenate(ids), np.concatenate(asks), np.concatenate(parts)
            if asking.all() or not asking.any():
                return
            out: list[list] = [[], [], []]
            for q, near, score in search(x[asking], who[asking], x[~asking], who[~asking], k):
                out[0] += [q] * len(near)
                out[1] += near.tolist()
                out[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

        for b in batches:
            place = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "qblock", "dim")), strict=True))
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z == a:
                    continue
                if place[a] != key:
                    yield from found()
                    key, ids, asks, parts = place[a], [], [], []
                s = b.slice(a, z - a)
                ids.append(s.column(s.schema.get_field_index("vec_id")).to_numpy())
                asks.append(s.column(s.schema.get_field_index("asks")).to_numpy(zero_copy_only=False))
                parts.append(s.column(s.schema.get_field_index("v")).flatten().to_numpy().reshape(z - a, place[a][2]))
        yield from found()

    near = placed.mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
