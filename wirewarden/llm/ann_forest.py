"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree is a sorted array of long hash strings (the signs of random projections). A query descends every tree to its
longest prefix match and ascends all trees in step, a bit at a time, until the prefix ranges hold enough candidates; only those
candidates are compared. Rows are dealt out in blocks by a hash of their id, each with a forest of its own over all of its
rows, which one task builds once from the rows that come first and then searches for the queries that stream past it. How many candidates
are wanted is a share of the block, so that the work does not depend on how rows are spread. Every row is shuffled once; every
query is shuffled once for each block of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 48, 32
#: Rows of a block, and queries that are searched at once.
ROWS_IN_BLOCK, QUERIES_AT_ONCE = 16384, 512
#: Entries of the prefix ranges of all trees, as a share of the block's rows, at which the ascent stops.
QUOTA = 0.75
_SEED = 20240607


def hash_strings(vectors: np.ndarray) -> np.ndarray:
    """(TREES, rows) unsigned 64-bit strings, the first bit the highest."""
    planes = np.random.default_rng(_SEED).normal(size=(vectors.shape[1], TREES * BITS)).astype(np.float32)
    weights = (np.uint64(1) << np.arange(63, 63 - BITS, -1, dtype=np.uint64))
    out = np.empty((TREES, len(vectors)), dtype=np.uint64)
    for lo in range(0, len(vectors), 2048):
        signs = (vectors[lo : lo + 2048].astype(np.float32) @ planes > 0).reshape(-1, TREES, BITS)
        out[:, lo : lo + 2048] = (signs * weights).sum(axis=2, dtype=np.uint64).T
    return out


class Forest:
    def __init__(self, vectors: np.ndarray):
        keys = hash_strings(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.rows = len(vectors)

    def candidates(self, queries: np.ndarray):
        """For each query the rows that the synchronous ascent reaches."""
        keys = hash_strings(queries)
        n, wanted = keys.shape[1], QUOTA * self.rows + TREES  # a query meets its own row in every tree
        low, high = np.zeros((TREES, n), dtype=np.int64), np.full((TREES, n), self.rows)
        open_ = np.ones(n, dtype=bool)
        for depth in range(BITS, 0, -1):
            own = np.flatnonzero(open_)
            if not len(own):
                break
            rest = np.uint64((1 << (64 - depth)) - 1)
            first, last = keys[:, own] & ~rest, keys[:, own] | rest
            a = np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, first, strict=True)])
            b = np.stack([np.searchsorted(k, x, side="right") for k, x in zip(self.keys, last, strict=True)])
            enough = (b - a).sum(axis=0) >= wanted
            low[:, own[enough]], high[:, own[enough]] = a[:, enough], b[:, enough]
            open_[own[enough]] = False
        for q in range(n):
            seen = np.zeros(self.rows, dtype=bool)
            for t in range(TREES):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each divided by the power of two of its largest component: no square over- or underflows, and no cosine changes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class _Block:
    """The rows of one block: gathered first, then searched."""

    def __init__(self, k: int):
        self.k, self.parts, self.forest = k, [], None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((ids, vectors))

    def search(self, query_ids: np.ndarray, asked: np.ndarray):
        """(query ids, ids, scores) of the k nearest rows found for each query."""
        if self.forest is None:
            self.ids, self.vectors = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
            self.forest = Forest(self.vectors / self.norms[:, None])
        ids, vectors, norms, k = self.ids, self.vectors, self.norms, self.k
        asked_norms = np.sqrt((asked * asked).sum(axis=1))
        out: list[list] = [[], [], []]
        for q, found in enumerate(self.forest.candidates(asked / asked_norms[:, None])):
            found = found[ids[found] != query_ids[q]]
            if len(found) < k:  # too few others shared a prefix: the root holds every row
                found = np.flatnonzero(ids != query_ids[q])
            near = vectors[found] @ asked[q] / (norms[found] * asked_norms[q])
            if len(found) > 4 * k:  # then exactly, in an order of additions that depends on the vector alone
                near_enough = near >= np.partition(near, len(near) - 4 * k)[len(near) - 4 * k] - 1e-9
                found = found[near_enough]
            exact = (vectors[found] * asked[q]).sum(axis=1) / (norms[found] * asked_norms[q])
            best = np.lexsort((ids[found], -exact))
            _, first = np.unique(ids[found][best], return_index=True)  # an id that repeats counts once
            best = best[np.sort(first)][:k]
            out[0].append(np.full(len(best), query_ids[q])), out[1].append(ids[found][best]), out[2].append(exact[best])
        return map(np.concatenate, out)


def _search(k: int):
    """Rows (d, i, asks, id, v) sorted by block (d, i), in each the rows before the queries -> (query_id, vec_id, score)."""
    def run(batches):
        now, block = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "i", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if now != tuple(keys[lo, :2]):
                    now, block = tuple(keys[lo, :2]), _Block(k)
                if not keys[lo, 2]:
                    block.add(b.column("id")[lo:hi].to_numpy(), _matrix(b.column("v")[lo:hi]))
                elif block.parts or block.forest:
                    for at in range(lo, hi, QUERIES_AT_ONCE):
                        some = slice(at, min(at + QUERIES_AT_ONCE, hi))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.search(b.column("id")[some].to_numpy(), _matrix(b.column("v")[some]))], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that is a query the k nearest others found, by the cosine of the original
    vectors in double precision, ties to the smaller id; fewer if there are fewer candidates.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without an id;
    vectors are compared with those of their own length. Of rows that share an id the best counts. An empty table
    gives an empty result.
    """
    v = F.col("v")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asked")).filter(
        F.col("id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).withColumn("d", F.size(v))
    blocks = max(1, -(-usable.count() // ROWS_IN_BLOCK))
    columns = ["d", "i", "asks", "id", "v"]
    kept = usable.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"), F.lit(0).alias("asks")).select(columns)
    asking = usable.filter("asked").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.lit(1).alias("asks")).select(columns)
    dealt = kept.union(asking).repartition(blocks, "d", "i").sortWithinPartitions("d", "i", "asks")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
