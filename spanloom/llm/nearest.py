"""Approximate nearest neighbours by inner product: one vantage-point tree for each shard of the vectors.

Largest inner products become nearest points: a vector x of norm |x| gets a further coordinate sqrt(M^2 - |x|^2), M the greatest
norm of all, and a query q gets 0, so that the squared distance is |q|^2 + M^2 - 2 q.x. A shard groups its equal vectors, takes
the median distance from a vantage point to split the rest in two, again and again, and keeps small leaves as blocks. All
queries go through every shard's tree in blocks: nearer side first, and the other side only if the vantage distance leaves
room for something nearer than the k-th found, by the triangle inequality. That room is divided by `relax`: 1 is exact search,
more prunes more. What is found is scored again on the original vectors, exactly rounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, table

#: Vectors of a shard, about; points of a leaf; queries that go through a tree together; relaxing factor of the query op10.
SHARD_ROWS, LEAF, QUERY_BLOCK, RELAX = 16_384, 128, 1024, 1.1


class Tree:
    """A vantage-point tree over distinct points; nodes are (vantage, radius, inside, outside), leaves are index arrays."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own
        vantage, rest = own[0], own[1:]  # the points come in hash order, so the first is as good as a random one
        far = np.sqrt(np.maximum(((self.points[rest] - self.points[vantage]) ** 2).sum(1), 0))
        radius = float(np.median(far))
        near = far <= radius
        if near.all():
            order = np.argsort(far, kind="stable")
            near = np.zeros(len(rest), bool)
            near[order[: len(rest) // 2]] = True
        return vantage, far[near].max(initial=0.0), far[~near].min(initial=np.inf), self._grow(rest[near]), self._grow(rest[~near])

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the indexes and distances of the k nearest points found, nearest first; short of k: -1 and inf."""
        index = np.full((len(queries), k), -1, np.int64)
        far = np.full((len(queries), k), np.inf)
        norms = (self.points**2).sum(1)
        q_norms = (queries**2).sum(1)

        def offer(who: np.ndarray, points: np.ndarray) -> None:
            found = np.sqrt(np.maximum(q_norms[who][:, None] + norms[points] - 2 * queries[who] @ self.points[points].T, 0))
            every = np.c_[far[who], found]
            ids = np.c_[index[who], np.broadcast_to(points, found.shape)]
            best = np.argpartition(every, k - 1, axis=1)[:, :k] if every.shape[1] > k else np.broadcast_to(np.arange(k), (len(who), k))
            far[who], index[who] = np.take_along_axis(every, best, 1), np.take_along_axis(ids, best, 1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(who, node)
                return
            vantage, inner, outer, inside, outside = node
            offer(who, np.array([vantage]))
            away = np.sqrt(np.maximum(((queries[who] - self.points[vantage]) ** 2).sum(1), 0))
            inside_first = away <= (inner + min(outer, 2 * inner + 1)) / 2
            for first in (True, False):
                group, distance = who[inside_first == first], away[inside_first == first]
                for go_in in (first, not first):
                    # nothing inside is nearer than away - inner, nothing outside than outer - away
                    room = distance - inner if go_in else outer - distance
                    worth = room <= far[group].max(axis=1) / relax + 1e-9
                    visit(inside if go_in else outside, group[worth])

        visit(self.root, np.arange(len(queries)))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(index, order, 1), np.take_along_axis(far, order, 1)


class Shard:
    """Distinct vectors of a shard, each with the least k + 1 ids that have it, in a tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(group.ravel(), minlength=len(self.vectors)))]
        self.ids = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(bounds[:-1], bounds[1:])]
        mixed = np.argsort(first * 0x9E3779B1 % (1 << 32), kind="stable")
        self.vectors, self.ids = self.vectors[mixed], [self.ids[i] for i in mixed]
        self.tree = Tree(np.c_[self.vectors, np.sqrt(np.maximum(greatest**2 - (self.vectors**2).sum(1), 0))])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> Iterator[tuple[int, int, float]]:
        found, far = self.tree.search(np.c_[queries, np.zeros(len(queries))], k + 1, relax)
        for q, query, indexes, distances in zip(query_ids.tolist(), queries, found, far):
            scored = [(math.fsum((query * self.vectors[i]).tolist()), i) for i in indexes.tolist() if i >= 0]
            best = sorted(((-s, v, s) for s, i in scored for v in self.ids[i].tolist() if v != q))[:k]
            yield from ((q, v, s) for _, v, s in best)


def _search(k: int, relax: float, greatest: float):
    """Works on rows sorted by (shard, role): a shard's vectors come first, then the queries in blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        own: list[tuple[np.ndarray, np.ndarray]] = []  # ids and vectors of the shard, then of the queries that wait
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if not own or not waiting:
                waiting.clear()
                return
            if shard is None:
                shard = Shard(*map(np.concatenate, zip(*own)), greatest, k)
            ids, queries = map(np.concatenate, zip(*waiting))
            waiting.clear()
            for at in range(0, len(ids), QUERY_BLOCK):
                out = list(shard.nearest(ids[at : at + QUERY_BLOCK], queries[at : at + QUERY_BLOCK], k, relax))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys, is_query, ids = batch.column("shard").to_pylist(), np.asarray(batch.column("is_query")), np.asarray(batch.column("vec_id"))
            bounds, values = np.asarray(batch.column("vector").offsets), np.asarray(batch.column("vector").values)
            new = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or is_query[i] != is_query[i - 1]]
            for at, end in zip([0, *new], [*new, len(keys)]) if keys else ():
                if keys[at] != now:
                    yield from answer()
                    shard, now = None, keys[at]
                    own.clear()
                (waiting if is_query[at] else own).append((ids[at:end].copy(), values[bounds[at] : bounds[end]].reshape(end - at, -1).copy()))
                if sum(len(w[0]) for w in waiting) >= QUERY_BLOCK:
                    yield from answer()
        yield from answer()

    return work


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, relax: float = RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """embeddings(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found for each vec_id divisible by `every`.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query's own row is no candidate. Fewer
    candidates than k: all. Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids;
    vectors of different lengths are not compared; a repeated row counts once.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = embeddings.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    vectors = checkpointed(vectors.dropDuplicates(["vec_id", "vector"]))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    lengths = vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"))
    lengths = lengths.select("length", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), "norm")
    greatest = math.sqrt(lengths.agg(F.max("norm")).first()[0] or 0.0)
    placed = vectors.withColumn("length", F.size("vector")).join(lengths.select("length", "shards"), "length")
    shard = lambda i: F.struct("length", i.cast("int").alias("at"))
    indexed = placed.select(shard(F.pmod(F.xxhash64("vec_id"), "shards")).alias("shard"), F.lit(0).alias("is_query"), "vec_id", "vector")
    asked = placed.filter(F.col("vec_id") % every == 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), shard)).alias("shard"), F.lit(1).alias("is_query"), "vec_id", "vector")
    dealt = indexed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "is_query", "vec_id").withColumn("shard", F.concat_ws("-", "shard.length", "shard.at"))
    found = dealt.mapInArrow(_search(k, relax, greatest), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
