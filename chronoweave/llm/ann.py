"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking.

The trees are grown on a bounded sample (FIT_ROWS); each node projects on the line between two random
points, moved apart by a few 2-means steps, and splits at the middle. Every row of the table is then put
into one leaf per tree. For a query, all trees share a queue of branches, ordered by how far the query lies
from the splits on the way; leaves are taken from it until they hold `budget` rows. Rows in any of these
leaves are candidates, and their exact distances decide.

The budget is what RECALL of the true neighbours of CALIBRATED sample queries needed, found by brute force,
so unstructured vectors get a wide search and clustered ones a narrow one.

Queries come in blocks of bounded size to all parts of the index, in which each part keeps its own nearest
rows; no leaf is ever gathered in one place, so leaves of any size, and many equal vectors, cause no skew.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace

TREES, LEAF, FIT_ROWS = 16, 64, 16_384
CALIBRATED, RECALL = 48, 0.97
QUERY_BLOCK = 1024


class Forest:
    """Nodes in arrays: planes and offsets of inner nodes, children (a leaf is -1 - its number), one root per tree."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        self.planes, self.offsets, self.children, self.leaf_tree = [], [], [], []
        self.rng, self.leaf = np.random.default_rng(seed), leaf
        self.roots = [self._grow(sample, np.arange(len(sample)), t) for t in range(trees)]
        dims = sample.shape[1] if sample.ndim == 2 else 0
        self.planes = np.array(self.planes).reshape(-1, dims)
        self.offsets = np.array(self.offsets)
        del self.rng

    def _grow(self, x: np.ndarray, rows: np.ndarray, tree: int) -> int:
        stack = [(rows, None, 0)]
        root = None
        while stack:
            rows, parent, side = stack.pop()
            cut = self._split(x, rows) if len(rows) > self.leaf else None
            if cut is None:
                name = -1 - len(self.leaf_tree)
                self.leaf_tree.append(tree)
            else:
                name = len(self.planes)
                plane, offset, right = cut
                self.planes.append(plane)
                self.offsets.append(offset)
                self.children.append([0, 0])
                stack += [(rows[~right], name, 0), (rows[right], name, 1)]
            if parent is None:
                root = name
            else:
                self.children[parent][side] = name
        return root

    def _split(self, x: np.ndarray, rows: np.ndarray):
        some = x[self.rng.choice(rows, min(len(rows), 200), replace=False)]
        a, b = some[0], some[1]
        for _ in range(3):
            near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = some[near].mean(0), some[~near].mean(0)
        plane = a - b
        norm = np.linalg.norm(plane)
        if norm == 0:
            return None
        plane = plane / norm
        offset = (a + b) @ plane / 2
        right = x[rows] @ plane > offset
        return (plane, offset, right) if right.any() and not right.all() else None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = -1 - node
                elif len(rows):
                    right = x[rows] @ self.planes[node] > self.offsets[node]
                    stack += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def order(self, q: np.ndarray, population: np.ndarray, budget: float) -> tuple[list[int], list[int]]:
        """Leaves in the order of the shared queue until they hold budget rows, and the rows so far."""
        margin = (self.planes @ q - self.offsets).tolist()
        queue = [(0.0, i, root) for i, root in enumerate(self.roots)]
        leaves, sums, total, tie = [], [], 0, len(queue)
        while queue and total < budget:
            far, _, node = heapq.heappop(queue)
            while node >= 0:
                m, (left, right) = margin[node], self.children[node]
                near, other = (right, left) if m > 0 else (left, right)
                tie += 1
                heapq.heappush(queue, (max(far, abs(m)), tie, other))
                node = near
            leaves.append(-1 - node)
            total += int(population[-1 - node])
            sums.append(total)
        return leaves, sums


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _nearest(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of some rows of x, ties to smaller ids."""
    rows = rows[ids[rows] != own]
    d = np.sqrt(((x[rows] - q) ** 2).sum(1))
    if len(rows) > 4 * k:
        keep = d <= np.partition(d, k - 1)[k - 1]
        rows, d = rows[keep], d[keep]
    by = np.lexsort((ids[rows], d))[:k]
    return ids[rows[by]], d[by]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double"


def _pass(index: DataFrame, block: list, dims: int, k: int, leaves: int) -> DataFrame:
    """Nearest candidates of a block of queries (id, vector, leaves or None for all) in each part of the index."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches if shared.value else ():
            x, ids = _matrix(batch.column("embedding"), dims), batch.column("vec_id").to_numpy()
            own = batch.column("leaves").flatten().to_numpy().reshape(len(ids), -1)
            out: tuple = ([], [], [])
            for q_id, q, visited in shared.value:
                if visited is None:
                    rows = np.arange(len(ids))
                else:
                    open_ = np.zeros(leaves, bool)
                    open_[visited] = True
                    rows = np.flatnonzero(open_[own].any(1))
                near, d = _nearest(x, ids, rows, q, q_id, k)
                out[0].append(np.full(len(near), q_id))
                out[1].append(near)
                out[2].append(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, _FOUND)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: not null, not zero, all components finite,
    and as long as most vectors are (ties: the longer)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and embedding is not null")
    v = v.where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)")
    sizes = v.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return v.where(F.size("embedding") == (sizes[0].n if sizes else 0))


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that is_query selects.

    Candidates are all rows with another vec_id; score is the Euclidean distance in double precision. Rows
    that usable() rejects are neither queries nor candidates. A query returns as many rows as there are
    candidates, up to k; repeated rows of a query's vec_id are one query, the one with the smallest vector,
    and repeated rows of a candidate can each be found. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    v = usable(vectors)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = len(sample["embedding"][0])
    forest = Forest(_matrix(sample["embedding"].combine_chunks(), dims), trees)
    n_leaves = len(forest.leaf_tree)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            leaves = shared.value.place(_matrix(batch.column("embedding"), dims))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1]).astype(np.int32)), pa.array(leaves.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), listed], names=["vec_id", "embedding", "leaves"])

    index = ws.stage(v.mapInArrow(place, "vec_id long, embedding array<double>, leaves array<int>"), "index")
    population = np.zeros(n_leaves, np.int64)
    for r in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per leaf
        population[r.leaf] = r.n

    queries = index.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    budget = _calibrated(index, queries, forest, population, dims, k)
    counts = spark.sparkContext.broadcast(population)

    def visit(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), dims)
            leaves = [shared.value.order(q, counts.value, budget)[0] for q in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves"])

    planned = ws.stage(queries.mapInArrow(visit, "vec_id long, embedding array<double>, leaves array<int>"), "queries")
    passes, block = [], []
    for row in planned.toLocalIterator():
        block.append((row.vec_id, np.array(row.embedding), np.array(row.leaves, np.int32)))
        if len(block) == QUERY_BLOCK:
            passes.append(ws.stage(_pass(index, block, dims, k, n_leaves), "found"))
            block = []
    found = _pass(index, block, dims, k, n_leaves)
    for p in passes:
        found = found.union(p)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(index: DataFrame, queries: DataFrame, forest: Forest, population: np.ndarray, dims: int, k: int) -> float:
    """Rows to visit so that RECALL of the sample queries' true neighbours are among them."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATED).collect()
    if not some:
        return 0
    block = [(r.vec_id, np.array(r.embedding), None) for r in some]
    true = _best(_pass(index, block, dims, k, len(population)), k).select("query_id", "vec_id")
    placed = F.broadcast(true).join(index.select("vec_id", "leaves"), "vec_id").collect()  # k rows per sample query
    upto = {}
    for q_id, q, _ in block:
        leaves, sums = forest.order(q, population, np.inf)
        own = np.full(len(population), np.iinfo(np.int64).max)
        own[leaves] = sums
        upto[q_id] = own
    needed = [int(upto[r.query_id][r.leaves].min()) for r in placed]
    least = 16 * k * len(forest.roots)
    return float(max(least, np.quantile(needed, RECALL))) if needed else float(least)
