"""Approximate nearest neighbours by cosine from low-dimensional stable projections.

Unit vectors are projected on a few Gaussian directions; squared projected distance over squared distance follows a
chi-square law. Every block of rows indexes its projections in a kd-tree. A query takes projected neighbours from near to
far, verifies each on the full vector, and stops when a closer one would have shown itself by now with the wanted chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.cells import by_cell, cells
from factloom.plans.session import materialize

DIRECTIONS = 8  # even, for the closed form of the chi-square law
CHANCE = 0.97  # with which each true neighbour is met before the search stops
LEAF = 48
BLOCK_ROWS = 1 << 18  # rows of a block, at most in expectation
LEAST_BLOCKS = 24
QUERY_ROWS = 20_000  # queries that one task asks of its block


def chi_square_quantile(chance: float, freedom: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection of its closed form."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1.0
    while below(high) < chance:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < chance else (low, (low + high) / 2)
    return high


def directions(width: int, count: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, count))


@dataclass
class Tree:
    """Leaves of a kd-tree: order lists the points leaf by leaf, starts has the borders, low and high the boxes."""

    order: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve at the median of the widest side until a part has at most `leaf` points."""
    leaves, open_parts = [], [np.arange(len(points))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= leaf:
            leaves.append(part)
            continue
        here = points[part]
        side = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        halves = np.argpartition(here[:, side], len(part) // 2)
        open_parts += [part[halves[:len(part) // 2]], part[halves[len(part) // 2:]]]
    starts = np.cumsum([0] + [len(x) for x in leaves])
    return Tree(np.concatenate(leaves), starts, np.stack([points[x].min(axis=0) for x in leaves]), np.stack([points[x].max(axis=0) for x in leaves]))


class Block:
    """Searchable rows of one width."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, chance: float = CHANCE, count: int = DIRECTIONS):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.axes, self.bound = directions(vectors.shape[1], count), chi_square_quantile(chance, count)
        projected = (vectors / norms[:, None]) @ self.axes
        self.tree = build_tree(projected)
        self.ids, self.vectors, self.norms = ids[self.tree.order], vectors[self.tree.order], norms[self.tree.order]
        self.units = self.vectors / self.norms[:, None]

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[float], int]:
        """Ids and cosines of the k nearest found, best first and ties to the smaller id, and how many rows were verified."""
        norm = math.sqrt((query * query).sum())
        unit, tree = query / norm, self.tree
        place = unit @ self.axes
        outside = np.maximum(np.maximum(tree.low - place, place - tree.high), 0)
        distance = (outside * outside).sum(axis=1)
        leaves = np.argsort(distance, kind="stable")
        seen, likeness, kth, at, step = [], [], -np.inf, 0, 2
        while at < len(leaves) and (kth == -np.inf or distance[leaves[at]] <= self.bound * max(2 - 2 * kth, 0) + 1e-9):
            for leaf in leaves[at:at + step]:
                rows = slice(tree.starts[leaf], tree.starts[leaf + 1])
                seen.append(np.arange(rows.start, rows.stop))
                likeness.append(self.units[rows] @ unit)
                likeness[-1][self.ids[rows] == own] = -np.inf
            at, step = at + step, min(2 * step, 32)
            flat = np.concatenate(likeness)
            if len(flat) > k:
                kth = np.partition(flat, len(flat) - k)[len(flat) - k]
        if not seen:
            return [], [], 0
        flat, rows = np.concatenate(likeness), np.concatenate(seen)
        rows = rows[(flat >= kth - 1e-9) & (flat > -np.inf)]
        scores = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best].tolist(), scores[best].tolist(), len(flat)


def sound_rows(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector: rows that can take part. No null id; not null, empty, all zero, nor with null or non-finite parts.
    Of rows with one id the smallest vector counts, once."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(v.cast("array<double>")).alias("vector"))


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                       block_rows: int = BLOCK_ROWS, chance: float = CHANCE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where is_query (a condition on vec_id) holds, the k nearest of all
    other rows found, by cosine, ties to the smaller id; fewer only if there are fewer rows.

    Vectors of different widths never meet. Of identical vectors only the k + 1 smallest ids are indexed: the others can be in
    no answer, so a very common vector costs no more than a rare one. Other columns take no part; an empty table gives none."""
    rows = materialize(sound_rows(table, vec_id, vector), "vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    queries = rows.filter(is_query)
    blocks = max(LEAST_BLOCKS, -(-rows.count() // block_rows))
    chunks = max(1, -(-queries.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    indexed = indexed.select("vec_id", "vector", F.lit(False).alias("asks"), dealt(blocks).alias("block"), every(chunks).alias("chunk"))
    queries = queries.select("vec_id", "vector", F.lit(True).alias("asks"), every(blocks).alias("block"), dealt(chunks).alias("chunk"))
    cell = (F.size("vector").cast("long") * blocks + F.col("block")) * chunks + F.col("chunk")  # widths never share a cell

    def matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = part.column("vec_id").to_numpy()
        return ids, part.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            asked, data = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
            found: list[tuple] = []
            if data.num_rows and asked.num_rows:
                block = Block(*matrix(data), chance)
                for own, query in zip(*matrix(asked)):
                    ids, scores, verified = block.nearest(own, query, k)
                    found += [(int(own), i, s, verified) for i, s in zip(ids, scores)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score", "verified"])

    rows_of_cells = by_cell(indexed.union(queries).withColumn("cell", cell), "asks", "vec_id", "vector")
    hits = rows_of_cells.mapInArrow(search, "query_id long, vec_id long, score double, verified long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
