"""Exact top-k inner-product search with KD-trees.

Vectors are dealt by hash into shards of about SHARD_ROWS and queries into blocks; a task holds one block and
SHARDS_PER_TASK shards, which it searches one after the other, carrying each query's kth score. A shard's tree splits
the widest dimension at the median and keeps tight boxes; a query visits nodes best first by the largest inner product
that a box allows and stops when no open node can reach its kth score. Scores are integers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, runs

SHARD_ROWS = 8192
SHARDS_PER_TASK = 4
QUERY_BLOCK = 2048
LEAF = 64
LONG = (1 << 63) - 1


class Tree:
    """children[i] is None for a leaf, whose rows are order[a:b]."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lo, hi = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[self.order[a:b]]
            low, high = rows.min(0), rows.max(0)
            i = len(self.spans)
            self.spans.append((a, b))
            self.children.append(None)
            lo.append(low)
            hi.append(high)
            if parent >= 0:
                was = self.children[parent]
                self.children[parent] = (i, was[1]) if side == 0 else (was[0], i)
            d = int(np.argmax(high - low))
            if b - a > LEAF and high[d] > low[d]:
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, d], m)]
                self.children[i] = (-1, -1)
                todo += [(a, a + m, i, 0), (a + m, b, i, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product with a point of the box."""
        return np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T


def whole(values: np.ndarray, dim: int) -> np.ndarray:
    """floor(1024 * x) as doubles, which are integers; rows of dim components."""
    return np.floor(values.astype(np.float64) * 1024).reshape(-1, dim)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, best: list[list[tuple]], k: int) -> None:
    """Pushes a shard's rows into each query's heap of (score, -vec_id), the worst of the k best first."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if not most < 1 << 53:  # beyond what doubles hold exactly
        big = np.array([[int(v) for v in row] for row in x], object)
        for i, query in enumerate(q):
            for vec, score in zip(ids.tolist(), big @ np.array([int(v) for v in query], object), strict=True):
                if vec != query_ids[i]:
                    push(best[i], (max(-LONG - 1, min(LONG, score)), -vec), k)
        return
    tree = Tree(x)
    x, ids = x[tree.order], ids[tree.order]
    bounds = tree.bounds(q)
    for i, query in enumerate(q):
        own, mine, bound = best[i], int(query_ids[i]), bounds[i]
        heap = [(-bound[0], 0)]
        while heap:
            least, node = heapq.heappop(heap)
            if len(own) == k and -least < own[0][0]:
                break
            if (kids := tree.children[node]) is not None:
                for c in kids:
                    if len(own) < k or bound[c] >= own[0][0]:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree.spans[node]
            score = x[a:b] @ query
            for j in np.flatnonzero(score >= own[0][0]).tolist() if len(own) == k else range(b - a):
                if (vec := int(ids[a + j])) != mine:
                    push(own, (int(score[j]), -vec), k)


def push(heap: list[tuple], item: tuple, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def top_k(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest integer inner products, ties to the smaller vec_id.

    vectors has vec_id and embedding; is_query is a condition on them. Vectors that are null or empty, or hold null or
    non-finite components, and null ids take no part. Rows with the query's own vec_id are not its candidates; repeated
    candidate rows count each, repeated queries once. A query meets the vectors of its own length only. Scores beyond
    64 bits are clamped. Other columns are ignored, an empty table gives no rows.
    """
    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~odd)
    rows = rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("vec_id", "embedding").alias("h"))
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "h"])
    n_groups = max(1, -(-rows.count() // (shard_rows * SHARDS_PER_TASK)))
    n_blocks = max(1, -(-queries.count() // query_block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.pmod("h", F.lit(n_groups)).cast("int").alias("group"), numbers(n_blocks).alias("block"), F.lit(False).alias("query"))
    right = queries.select("*", numbers(n_groups).alias("group"), F.pmod("h", F.lit(n_blocks)).cast("int").alias("block"), F.lit(True).alias("query"))
    task = F.concat_ws("/", "dim", "group", "block").alias("task")
    dealt = left.unionByName(right).select(task, "query", "vec_id", "h", "embedding")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "task"):
            dim = int(group["task"][0].as_py().split("/")[0])
            asks = group["query"].to_numpy()
            x = whole(group["embedding"].combine_chunks().flatten().to_numpy(), dim)
            ids, h = group["vec_id"].to_numpy(), group["h"].to_numpy()
            at = np.flatnonzero(~asks)
            at, own = at[np.lexsort((h[at], ids[at]))], np.flatnonzero(asks)
            best: list[list[tuple]] = [[] for _ in own]
            for shard in np.array_split(at, max(1, -(-len(at) // shard_rows))):
                if len(shard) and len(own):
                    search(ids[shard], x[shard], ids[own], x[own], best, k)
            out = [(int(ids[o]), int(h[o]), -v, s) for o, found in zip(own, best, strict=True) for s, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["query_id", "query_key", "vec_id", "score"])

    # More partitions than tasks' worth of work, so that two of them seldom meet; empty ones cost little.
    found = by_key(dealt, "task", 3 * n_groups * n_blocks).mapInArrow(searched, "query_id long, query_key long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
