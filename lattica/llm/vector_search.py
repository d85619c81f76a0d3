"""Nearest neighbours by largest inner product with a vantage-point tree in each shard.

The largest inner product is the nearest point once every vector gets one more coordinate,
the square root of M**2 - |x|**2 with M the largest length, and queries get 0 there: then
|q - x|**2 = |q|**2 + M**2 - 2 q.x, a true distance, and the triangle inequality holds.

Rows are dealt to shards of a bounded size, and each shard's tree is built once: a node
takes a vantage point far from a random one, and splits the rest at their median distance
to it. A query at distance d from the vantage point of a ball of radius r can skip the
ball's inside if d - r, and the outside if r - d, is over its k-th best distance so far.
FACTOR relaxes that bound: FACTOR times the k-th best distance is what a side must be
within. With 1 the search is exact; less prunes more and may miss. Blocks of queries walk
a tree together, nearer sides first, and leaves are compared by matrix products.

Trees stay where they were built. Queries come past them in broadcast batches of a bounded
size; a task keeps the best of each query over all its trees and hands out only those.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, freed, read_table

#: Vectors of a shard and queries of a batch, on average; queries that walk together and
#: vectors of a leaf, at most.
SHARD, BATCH, BLOCK, LEAF = 4096, 16384, 1024, 128
K, FACTOR, SEED = 20, 0.9, 5
_NONE = np.iinfo(np.int64).min


class VantageTree:
    """A tree over rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        rng = np.random.default_rng(SEED)
        self.root = self._build(np.arange(len(points)), rng)

    def _build(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= self.leaf:
            return rows
        p = self.points[rows]
        far = ((p - p[rng.integers(len(rows))]) ** 2).sum(axis=1).argmax()
        d = np.sqrt(((p - p[far]) ** 2).sum(axis=1))
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # many equal points: nothing to split by
            return rows
        return (p[far], radius, self._build(rows[inside], rng), self._build(rows[~inside], rng))

    def search(self, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None, counter: list[int] | None = None) -> np.ndarray:
        """Rows of the k nearest points to each query; fewer are filled with -1. Points
        farther than ``limit`` are of no use."""
        n = len(queries)
        limit = np.full(n, np.inf) if limit is None else limit
        ids = np.full((n, k), -1, dtype=np.int64)
        best = np.full((n, k), np.inf)
        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            node, who, least = stack.pop()
            ok = least <= factor * np.minimum(best[who, -1], limit[who])
            who, least = who[ok], least[ok]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                if not len(node):
                    continue
                if counter is not None:
                    counter[0] += len(who) * len(node)
                p = self.points[node]
                q = queries[who]
                d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (q @ p.T), 0))
                all_d = np.concatenate([best[who], d], axis=1)
                all_i = np.concatenate([ids[who], np.broadcast_to(node, d.shape)], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :k]
                best[who] = np.take_along_axis(all_d, order, 1)
                ids[who] = np.take_along_axis(all_i, order, 1)
                continue
            centre, radius, inner, outer = node
            d = np.sqrt(((queries[who] - centre) ** 2).sum(axis=1))
            into, out = np.maximum(least, d - radius), np.maximum(least, radius - d)
            near_in = d <= radius
            # Those nearer the inside go there first, and the others outside first; what
            # is pushed last is searched first.
            for group, first, second, f, s in ((near_in, inner, outer, into, out), (~near_in, outer, inner, out, into)):
                if group.any():
                    stack.append((second, who[group], s[group]))
                    stack.append((first, who[group], f[group]))
        return ids


def usable(vector: str = "embedding"):
    """Neither null nor empty nor zero, and only finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column]) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each row of
    ``queries`` (both vec_id, embedding), by inner product in double precision.

    Unusable vectors (see usable()) and null ids take no part; nor do vectors of another
    dimension than the query's. A row is no candidate of a query with its id. Ties go to
    the smaller id; a repeated row is a candidate each time. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")]
    points = cut(vectors.filter(usable() & F.col("vec_id").isNotNull()).select(*columns))
    asked = cut(queries.filter(usable() & F.col("vec_id").isNotNull()).select(*columns))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, longest = points.agg(F.count(F.lit(1)), F.max(square)).first()
    longest = longest or 0.0
    n_shards, n_batches = -(-(total or 1) // SHARD), -(-(asked.count() or 1) // BATCH)

    def lifted(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
        return np.concatenate([v, rest[:, None]], axis=1)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        # Equal vectors are one point. Of its ids only the k + 1 smallest can be among the
        # k nearest of any query, as ties go to smaller ids and a query may be one of them.
        rows, point = np.unique(_matrix(group["v"]), axis=0, return_inverse=True)
        ids = group["vec_id"].to_numpy()
        order = np.lexsort((ids, point.ravel()))
        ids, point = ids[order], point.ravel()[order]
        keep = np.arange(len(ids)) - np.searchsorted(point, point) <= k
        ids, point = ids[keep], point[keep]
        ends = np.searchsorted(point, np.arange(len(rows) + 1))
        return pd.DataFrame({"dim": [rows.shape[1]], "tree": [pickle.dumps((VantageTree(lifted(rows)), rows, ids, ends))]})

    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards))
    keyed = points.withColumn("shard", place).withColumn("dim", F.size("v"))
    # One task for some shards, as many tasks as run at a time or a few times that.
    keyed = keyed.repartition(min(n_shards, 4 * spark.sparkContext.defaultParallelism), "shard")
    trees = cut(keyed.groupBy("shard", "dim").applyInPandas(build, "dim int, tree binary"))
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(n_batches))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = None
    for b in range(n_batches):
        part = asked.filter(batch == b).toArrow()  # BATCH vectors on average
        ids, vs = part.column("vec_id").to_numpy(), part.column("v").combine_chunks()
        dims = np.diff(vs.offsets.to_numpy())
        own = {int(d): (ids[dims == d], vs.filter(pa.array(dims == d)).flatten().to_numpy().reshape(-1, d)) for d in np.unique(dims)}
        shared = spark.sparkContext.broadcast(own)
        found = trees.mapInArrow(_finder(shared, k, factor, longest), "query_id bigint, vec_id bigint, score double")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_batches > 1:
            top = cut(top)
            shared.destroy()
        done = top if done is None else done.union(top)
    return done


def _finder(shared, k: int, factor: float, longest: float):
    """The search of one batch of queries in all trees of a task."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = {d: (np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE)) for d, (ids, _) in asked.items()}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("tree"), strict=True):
                if dim in asked:
                    tree = pickle.loads(raw.as_buffer())
                    own, q = asked[dim]
                    for i in range(0, len(own), BLOCK):
                        part = slice(i, i + BLOCK)
                        _merge(tree, own[part], q[part], best[dim][0][part], best[dim][1][part], k, factor, longest)
        for dim, (score, ids) in best.items():
            at, col = np.nonzero(ids != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][at]), pa.array(ids[at, col]), pa.array(score[at, col])], ["query_id", "vec_id", "score"])

    return run


def _merge(built: tuple, own: np.ndarray, q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, factor: float, longest: float) -> None:
    """Put what a tree has into the best so far, ``score`` and ``ids``, in place."""
    tree, rows, vec_ids, ends = built
    slack = 1e-9 * (longest + (q * q).sum(axis=1)) + 1e-300
    square = (q * q).sum(axis=1) + longest
    limit = np.sqrt(np.maximum(square - 2 * score[:, -1], 0) + 2 * slack)
    near = tree.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), k + 9, factor, limit)
    at, col = np.nonzero(near >= 0)
    spot = near[at, col]
    exact = (q[at] * rows[spot]).sum(axis=1)
    # Distances are rounded, so the last of those found may tie with points that were not.
    lowest = np.full((len(q), k + 9), np.nan)
    lowest[at, col] = exact
    full = (near >= 0).all(axis=1)
    kth = np.where(full, -np.sort(-lowest, axis=1)[:, k], -np.inf)
    tied = np.flatnonzero(full & (np.nanmin(np.where(full[:, None], lowest, 0.0), axis=1) >= kth - slack))
    for i in range(0, len(tied), 64):
        some = tied[i : i + 64]
        a, b = np.nonzero(q[some] @ rows.T >= (kth - slack)[some][:, None])
        at, spot = np.concatenate([at[~np.isin(at, some)], some[a]]), np.concatenate([spot[~np.isin(at, some)], b])
    exact = (q[at] * rows[spot]).sum(axis=1)
    many = ends[spot + 1] - ends[spot]
    each = np.repeat(ends[spot], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at, exact, found = np.repeat(at, many), np.repeat(exact, many), vec_ids[each]
    other = found != own[at]
    old, place = np.nonzero(ids != _NONE)
    at = np.concatenate([at[other], old])
    exact, found = np.concatenate([exact[other], score[old, place]]), np.concatenate([found[other], ids[old, place]])
    order = np.lexsort((found, -exact, at))
    at, exact, found = at[order], exact[order], found[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    top = rank < k
    score[at[top], rank[top]], ids[at[top], rank[top]] = exact[top], found[top]


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
