"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (FIT_ROWS vectors, chosen by a hash of the vector). Every vector goes
to the leaf that it reaches by the nearest child at each node. A query visits leaves in the order of
a priority queue over the tree's nodes, keyed by distance to their centres. How many leaves is
calibrated: sample queries are run with widening visits until their mean recall against brute force
over the sample reaches RECALL; if it never does, all leaves are visited, which is exact.

Equal vectors are one candidate with its smallest ids, as many as a result can hold, so a vector that
a third of all rows share costs no more than another. Leaves with many different vectors or many queries
are split by hash into parts of bounded size; each part of the one and of the other is a task of its own.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, and so do rows with a null id. Repeated ids stay candidates each by its vector, nearest first.
Ties go to the smaller id. Fewer candidates than k: all of them. Empty table: no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prepare

#: The bound of the fitting sample, and the tree's shape.
FIT_ROWS, BRANCH, LEAF_ROWS = 60_000, 12, 60
#: Calibration: queries, the recall to reach, and what is added to the leaf visits then.
PROBES, RECALL, MARGIN = 256, 0.97, 1.25
#: Different vectors, and queries, in one part of a leaf.
PART_ROWS, PART_QUERIES = 20_000, 20_000


class Tree:
    """Nodes in arrays: centre, first child, number of children; leaf numbers for nodes without."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, count, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0], [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop(0)
            if len(own) <= LEAF_ROWS:
                continue
            c, label = self._kmeans(x[own], min(BRANCH, len(own)), rng)
            groups = [own[label == i] for i in range(len(c))]
            if max(map(len, groups)) == len(own):
                continue  # one place only: it can't be split
            kept = [i for i, g in enumerate(groups) if len(g)]
            first[node], count[node] = len(centres), len(kept)
            for i in kept:
                todo.append((len(centres), groups[i]))
                centres.append(c[i])
                first.append(0)
                count.append(0)
        self.centre, self.first, self.count = np.array(centres), first, count
        leaves = [i for i, n in enumerate(count) if not n]
        self.leaf = {node: i for i, node in enumerate(leaves)}

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            label = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(label, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, label, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return c, ((c**2).sum(1) - 2 * x @ c.T).argmin(1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if not self.count[node]:
                out[own] = self.leaf[node]
                continue
            f, n = self.first[node], self.count[node]
            c = self.centre[f : f + n]
            label = ((c**2).sum(1) - 2 * x[own] @ c.T).argmin(1)
            todo += [(f + i, own[label == i]) for i in range(n)]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            while self.count[node]:
                f, n = self.first[node], self.count[node]
                d = ((self.centre[f : f + n] - q) ** 2).sum(1)
                best = int(d.argmin())
                for i in range(n):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), f + i))
                node = f + best
            out.append(self.leaf[node])
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Leaf visits at which probes among the sample find so much of their true neighbours."""
    every = len(tree.leaf)
    leaf = tree.place(x)
    probes = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    norm = (x**2).sum(1)
    ranks = []  # of each true neighbour: how many leaves are visited until it is found
    for i in probes:
        d = norm - 2 * x @ x[i]
        d[i] = np.inf
        true = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else []
        at = {v: n for n, v in enumerate(tree.visit(x[i], every), 1)}
        ranks += [at[leaf[j]] for j in true]
    if not ranks:
        return every
    visits = 1
    ranks = np.array(ranks)
    while visits < every and (ranks <= visits).mean() < recall:
        visits = min(every, max(visits + 1, int(visits * MARGIN)))
    return min(every, int(np.ceil(visits * MARGIN)))


def usable(c: Column) -> Column:
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return c.isNotNull() & fine & F.exists(c, lambda v: v != 0)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 10, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors (vec_id, embedding); queries: which rows ask."""
    prepare(spark)
    scratch = Scratch(spark, "ann")
    v = vectors.select("vec_id", "embedding", queries.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    size = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return none
    v = v.filter(F.size("embedding") == size.d)
    kept = k + 1  # one more: a query isn't its own neighbour
    ranked = v.groupBy("embedding", "vec_id").agg(F.count(F.lit(1)).alias("copies")).withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    different = scratch.write(ranked.filter(F.col("r") <= kept).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "different")
    total = different.count()
    share = min(1.0, fit_rows / total)
    sample = different.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < int(share * (1 << 20))).select("embedding").orderBy("embedding").toArrow()
    x = _matrix(sample.column(0).combine_chunks())
    if not len(x):
        x = _matrix(different.limit(1).select("embedding").toArrow().column(0).combine_chunks())
    tree = Tree(x)
    shared, visits = spark.sparkContext.broadcast(tree), calibrate(tree, x, k)  # fewer nodes than fitted vectors

    def place(it):
        for batch in it:
            m = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.place(m)), *batch.columns], names=["leaf", *batch.schema.names])

    def widen(it):
        for batch in it:
            seen = [shared.value.visit(q, visits) for q in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

    element = v.schema["embedding"].dataType.simpleString()
    placed = scratch.write(different.mapInArrow(place, f"leaf long, embedding {element}, ids array<long>"), "placed")
    asking = v.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).distinct()
    asked = scratch.write(asking.mapInArrow(widen, f"query_id long, q {element}, leaves array<long>"), "asked")
    # a row a leaf; a leaf's vectors and its queries are both split by hash, and each part of the one meets each part of the other
    held = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).cast("int").alias("parts"))
    asks = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_QUERIES)).cast("int").alias("asks"))
    split = scratch.write(held.join(asks, "leaf"), "split")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = placed.join(F.broadcast(split), "leaf").withColumn("part", F.pmod(F.xxhash64("embedding"), F.col("parts")).cast("int")).withColumn("ask", every("asks"))
    asked = asked.select("query_id", "q", F.explode("leaves").alias("leaf")).join(F.broadcast(split), "leaf").withColumn("ask", F.pmod(F.xxhash64("query_id", "q"), F.col("asks")).cast("int")).withColumn("part", every("parts"))

    def nearest(key, left, right):
        q, c = _matrix(left.column("q").combine_chunks()), _matrix(right.column("embedding").combine_chunks())
        qid, ids = left.column("query_id").to_numpy(), right.column("ids").to_pylist()
        out: list[list] = [[], [], []]
        if len(q) and len(c):
            rough_c = (c**2).sum(1)
            for i in range(len(q)):
                rough = rough_c - 2 * c @ q[i]
                near = np.argpartition(rough, min(2 * kept, len(c)) - 1)[: 2 * kept] if len(c) > 2 * kept else np.arange(len(c))
                if len(near) < len(c):  # nothing that rounding could have put behind is lost
                    near = np.flatnonzero(rough <= rough[near].max() + 1e-9 * (1 + np.abs(rough).max()))
                d = np.sqrt(((c[near] - q[i]) ** 2).sum(1))
                found = sorted((dist, j) for dist, n in zip(d.tolist(), near.tolist()) for j in ids[n] if j != qid[i])[:k]
                out[0] += [qid[i]] * len(found)
                out[1] += [j for _, j in found]
                out[2] += [dist for dist, _ in found]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = asked.select("leaf", "part", "ask", "query_id", "q").groupBy("leaf", "part", "ask").cogroup(index.select("leaf", "part", "ask", "embedding", "ids").groupBy("leaf", "part", "ask")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    # a repeated id keeps its nearest vector
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
