"""Exact top-k inner products by best-first search in M-trees.

Vectors are quantised to integers, so scores are exact.  Candidates are dealt
into blocks of bounded size; each block is an M-tree of paged nodes with a
router, a covering radius and the distance to the parent's router.  Since
q.x = q.c + q.(x - c) <= q.c + |q| d(x, c), a node's best score is at most
q.router + |q| radius.  A queue holds a query's open nodes by that bound; the best
is opened next, and the search ends when it does not reach the k-th score.  Before
a child's router is multiplied, the bound q.parent + |q| (d(parent, child) + radius)
is tried, and within a page the stored d(x, router) plays the same part.

Queries come in blocks too; each pair of blocks is one task group, and the best
k of each are merged, ties to the smaller id.  Defined results: vectors that are
null, empty or hold null or non-finite components take no part; only vectors of
one length are compared; rows are told apart by themselves, so a row that shares its
id with a query is a candidate like others; rows without an id are candidates,
too, and come last among equal scores; extra columns are ignored; no vectors give
no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

PAGE = 256
FANOUT = 8
FOUND = "query long, query_id long, vec_id long, score long"
#: stands for a null id, after all others
NULL_ID = (1 << 63) - 1


class Node:
    __slots__ = ("router", "radius", "parent_distance", "children", "rows", "distances", "routers", "reaches")

    def __init__(self, x: np.ndarray, rows: np.ndarray, parent: np.ndarray | None):
        self.router = x[rows].mean(axis=0)
        self.distances = np.sqrt(((x[rows] - self.router) ** 2).sum(axis=1))
        self.radius = float(self.distances.max())
        self.parent_distance = 0.0 if parent is None else float(np.sqrt(((self.router - parent) ** 2).sum()))
        self.rows = rows
        self.children: list[Node] = []
        if len(rows) <= PAGE:
            return
        if self.radius == 0:
            self._adopt([Node(x, part, self.router) for part in np.array_split(rows, -(-len(rows) // PAGE))])
            return
        # seeds of the children: each the farthest point from those before
        seeds, gap = [int(self.distances.argmax())], np.full(len(rows), np.inf)
        near = np.zeros(len(rows), dtype=np.int64)
        for j in range(FANOUT):
            e = np.sqrt(((x[rows] - x[rows[seeds[j]]]) ** 2).sum(axis=1))
            near[e < gap] = j
            gap = np.minimum(gap, e)
            if gap.max() == 0:
                break
            seeds.append(int(gap.argmax()))
        self._adopt([Node(x, rows[near == j], self.router) for j in np.unique(near)])

    def _adopt(self, children: list[Node]) -> None:
        self.children = children
        self.routers = np.array([c.router for c in children])
        # no row of a child is farther from this node's router
        self.reaches = np.array([c.parent_distance + c.radius for c in children])


class MTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, row_keys: np.ndarray):
        self.x, self.ids, self.row_keys = x, ids, row_keys
        self.root = Node(x, np.arange(len(x)), None)
        self.longest = float(np.sqrt((x**2).sum(axis=1).max()))
        # products of doubles are exact up to 2**53; larger components go through 64-bit integers
        self.whole = x.astype(np.int64) if x.shape[1] * float(np.abs(x).max()) ** 2 >= 2.0**53 else None

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but ``own``, best first, ties to the smaller id."""
        length = float(np.sqrt(q @ q))
        slack = 1e-6 * (1 + length) * (1 + self.longest)
        best: list[tuple[int, int]] = []
        floor = -np.inf
        top = float(q @ self.root.router)
        # open nodes by the best score they can hold
        queue = [(-(top + length * self.root.radius), 0, self.root, top)]
        pushed = 0
        while queue:
            bound, _, node, middle = heapq.heappop(queue)
            if -bound + slack < floor:
                break
            if not node.children:
                rows = node.rows
                if floor > -np.inf:
                    # a row at distance d from the router scores at most middle + length * d
                    rows = rows[middle + length * node.distances + slack >= floor]
                rows = rows[self.row_keys[rows] != own]
                scores = self.x[rows] @ q if self.whole is None else self.whole[rows] @ q.astype(np.int64)
                if len(rows) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[keep], scores[keep]
                best += [(int(s), int(i)) for s, i in zip(scores, self.ids[rows]) if s >= floor]
                best.sort(key=lambda b: (-b[0], b[1]))
                del best[k:]
                if len(best) == k:
                    floor = best[-1][0]
                continue
            near = middle + length * node.reaches + slack >= floor
            products = node.routers[near] @ q
            for j, p in zip(np.flatnonzero(near).tolist(), products.tolist()):
                child = node.children[j]
                most = p + length * child.radius
                if most + slack >= floor:
                    pushed += 1
                    heapq.heappush(queue, (-most, pushed, child, p))
        return best


COLUMNS = ["query", "query_id", "vec_id", "score"]


def _stack(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            sizes, wanted = candidates["v"].map(len), queries["v"].map(len)
            for d in sorted(set(sizes) & set(wanted)):
                part, asked = candidates[sizes == d], queries[wanted == d]
                tree = MTree(_stack(part["v"]), part["vec_id"].to_numpy(dtype=np.int64), part["row"].to_numpy(dtype=np.int64))
                wanted_rows = zip(asked["row"].tolist(), asked["vec_id"].tolist(), _stack(asked["v"]))
                rows = [(own, name, i, s) for own, name, q in wanted_rows for s, i in tree.search(q, own, k)]
                found.append(pd.DataFrame(rows, columns=COLUMNS).astype("int64"))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in COLUMNS}, dtype="int64")

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, row): valid integer vectors; ``row`` tells rows apart and is fixed once the table is written."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = vectors.where((F.size(v) > 0) & F.forall(v, finite))
    return good.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    block: int = 8192,
    query_block: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the ids divisible by ``every``, candidates all other rows."""
    spark = vectors.sparkSession
    flat = Scratch(spark, "topk").save(quantised(vectors, id_col, vector_col, scale), "vectors")
    asks = (F.col("vec_id") % every == 0) & (F.col("vec_id") != NULL_ID)
    n, n_queries = flat.agg(F.count("*"), F.count_if(asks)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = flat.select("vec_id", "v", "row", deal(blocks).alias("b"), all_of(query_blocks).alias("qb"))
    right = flat.where(asks).select("vec_id", "v", "row", deal(query_blocks).alias("qb"), all_of(blocks).alias("b"))
    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score"
    )
