"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order. Each slice of the rows posts its
vectors in inverted files, one per pivot, with the pivot's place in the vector's order. A query
adds up, over the inverted files of its own pivots, how far the places agree: with pivots outside
a prefix at place `prefix`, the footrule distance is a constant less twice the sum of
prefix - max(place in query, place in vector) over shared pivots. The vectors of a slice with the
least footrule distance, `candidates` and `share` of its rows at least, are reranked by exact
Euclidean distance on the original components.

Pivots are a bounded sample of distinct vectors; every row is posted. Queries are the stated query
set and are broadcast in blocks of at most `block` rows. Slices have a fixed number of rows, so a task holds
one slice and its best `k` per query, and equal vectors of a slice are one candidate with all ids.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 512
PREFIX = 64
#: Reranked per slice and query: this many, and this share of a larger slice.
CANDIDATES = 1000
SHARE = 0.1
BLOCK = 4096
#: Rows of a slice.
SLICE = 10_000


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to q, in double precision."""
    return np.sqrt(((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(axis=1))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; ties go to the earlier pivot."""
    d = (x.astype(np.float64) ** 2).sum(1)[:, None] - 2 * x.astype(np.float64) @ pivots.T.astype(np.float64) + (pivots.astype(np.float64) ** 2).sum(1)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Slice:
    """Inverted files of one slice of the rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        view = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, group = np.unique(view, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))  # distinct vectors in order of their least id
        group = rank[group]
        members = np.argsort(group, kind="stable")
        self.ids, self.bounds = ids[members], np.concatenate([[0], np.cumsum(np.bincount(group))])
        self.x, self.prefix = x[np.sort(first)], prefix
        perms = permutations(self.x, pivots, prefix)
        flat = perms.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // perms.shape[1], (by_pivot % perms.shape[1]).astype(np.int32)
        self.lists = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def search(self, own: int, q: np.ndarray, perm: np.ndarray, candidates: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the best k, nearest first, ties to the smaller id; never the id own."""
        n = len(self.x)
        agree = np.zeros(n, np.int64)
        for place, pivot in enumerate(perm):
            s = slice(self.lists[pivot], self.lists[pivot + 1])
            agree[self.rows[s]] += self.prefix - np.maximum(place, self.places[s])
        if n > candidates:
            near = np.argpartition(agree * n + (n - 1 - np.arange(n)), n - candidates)[n - candidates :]
        else:
            near = np.arange(n)
        d = distances(self.x[near], q)
        best = near[np.lexsort((near, d))][: k + 1]
        ids = [self.ids[self.bounds[b] : self.bounds[b + 1]] for b in best]
        ids = [i[i != own][:k] for i in ids]
        far = np.concatenate([np.full(len(i), x) for i, x in zip(ids, distances(self.x[best], q))])
        ids = np.concatenate(ids)
        top = np.lexsort((ids, far))[:k]
        return ids[top], far[top]


def slices(batches, rows: int = SLICE):
    """Tables of about `rows` rows, whatever the size of the batches."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v: without null ids and vectors that are null, empty, zero, or hold null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most n distinct vectors of the most common length, drawn by a hash of the vector itself."""
    rows = vectors.select("v").distinct().orderBy(F.xxhash64("v")).limit(4 * n).collect()
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r["v"]) for r in rows]
    dims = max(sorted(set(sizes)), key=sizes.count)
    return np.array([r["v"] for r in rows if len(r["v"]) == dims][:n], dtype=np.float64).reshape(-1, dims)


def search(df: DataFrame, every: int = 100, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, candidates: int = CANDIDATES, share: float = SHARE, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every query (id divisible by `every`) its k nearest found.

    Null, empty or zero vectors, vectors with null or non-finite components and vectors of an
    unusual length take no part, as query or candidate. Ties go to the smaller id. Repeated ids
    are one query, with the first of their vectors, and each a candidate; a query never finds its
    own id. Fewer candidates than k give fewer rows; empty tables none. Other columns are not read.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df, vec_id, embedding)
    centres = choose_pivots(vectors, pivots)
    schema = "query_id long, vec_id long, score double"
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, width = centres.shape[1], min(prefix, len(centres))
    vectors = vectors.where(F.size("v") == dims)

    def passes(shared):
        def run(batches):
            ids, xs, perms = shared.value
            best: dict[int, tuple] = {}
            for t in slices(batches):
                part = Slice(t.column(0).to_numpy().astype(np.int64), t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dims), centres, width)
                rerank = max(candidates, math.ceil(share * len(part.x)))
                for n in range(len(ids)):
                    found = part.search(int(ids[n]), xs[n], perms[n], rerank, k)
                    if n in best:
                        i, d = (np.concatenate(z) for z in zip(best[n], found))
                        top = np.lexsort((i, d))[:k]
                        found = i[top], d[top]
                    best[n] = found
            for n, (i, d) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), ids[n])), pa.array(i), pa.array(d)], ["query_id", "vec_id", "score"])

        return vectors.mapInArrow(run, schema)

    asked = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
    found, part = [], []

    def flush():
        ids, xs = np.array([r["id"] for r in part], np.int64), np.array([r["v"] for r in part], dtype=np.float64)
        found.append(passes(spark.sparkContext.broadcast((ids, xs, permutations(xs, centres, width)))))
        part.clear()

    for row in asked.toLocalIterator():
        part.append(row)
        if len(part) == block:
            flush()
    if part:
        flush()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
