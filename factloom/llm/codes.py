"""Vector code compression: Lloyd's rounds over partition-local cover trees.

Vectors become integers and are cut into parts; each part position has a codebook. Every task builds a cover tree of its rows
for each part: nodes with a centre, a radius that covers all points below, and the sum and number of those points. In a
round a node goes to one entry as a whole when the triangle inequality shows that entry nearest for everything below;
only other nodes are opened, and only points are compared exactly. Trees are stored once and read by every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMIT = 1 << 27  # integers from here on, in size, would overflow exact sums
BLOCK = 4096  # rows of a tree
LEAF = 32


def build_tree(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Cover tree of integer points: order (a permutation, in which each node's points follow each other) and per node, from
    the root by levels: first and last (range in the order), child (its first child; children follow each other), children
    (0 for a leaf), centre (a point), radius and total (sum of its points).

    Children of a node have centres more than half its radius apart and cover what is within that half; each takes the points
    that no earlier one covers. Leaves have at most `leaf` points or one place."""
    place = points.astype(np.float64)
    order = np.arange(len(points))
    nodes, todo = [], [(0, len(points), 0)]
    for first, last, at in todo:  # grows while it is read
        rows = order[first:last]
        distance = np.sqrt(((place[rows] - place[at]) ** 2).sum(axis=1))
        radius = float(distance.max(initial=0.0))
        children = []
        if len(rows) > leaf and radius > 0:
            left, centre, kept = np.arange(len(rows)), at, []
            while len(left):
                away = np.sqrt(((place[rows[left]] - place[centre]) ** 2).sum(axis=1))
                near = away <= radius / 2
                kept.append(rows[left[near]])
                children.append((centre, len(kept[-1])))
                left = left[~near]
                centre = rows[left[0]] if len(left) else None
            order[first:last] = np.concatenate(kept)
        nodes.append((first, last, len(todo) if children else 0, len(children), at, radius))
        for centre, count in children:
            todo.append((first, first + count, centre))
            first += count
    first, last, child, children, at = (np.array([n[k] for n in nodes], np.int64) for k in range(5))
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    return {"order": order, "first": first, "last": last, "child": child, "children": children, "centre": points[at],
            "radius": np.array([n[5] for n in nodes]), "total": running[last] - running[first]}


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact, a column per entry."""
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def assign(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, sums with counts in the last column, points compared): the nearest entry of each point in the
    tree's order, ties to the lower entry; points are in that order."""
    codes = np.zeros(len(points), np.int64)
    sums = np.zeros((len(entries), points.shape[1] + 1), np.int64)
    compared, level = 0, np.array([0]) if len(points) else np.empty(0, np.int64)
    firsts = np.sort(np.unique(entries, axis=0, return_index=True)[1]) if len(entries) else np.empty(0, np.int64)
    if len(firsts) < len(entries):  # of equal entries only the lowest can be nearest
        codes, distinct, compared = assign(tree, points, entries[firsts])
        sums[firsts] = distinct
        return firsts[codes], sums, compared
    while len(level):
        far = np.sqrt(squared_distances(tree["centre"][level], entries).astype(np.float64))
        best = far.argmin(axis=1)
        nearest = far[np.arange(len(level)), best]
        slack = 1e-9 * (nearest + tree["radius"][level]) + 1e-9
        rivals = far - 2 * tree["radius"][level][:, None] <= (nearest + slack)[:, None] * (1 + 1e-9)
        rivals[np.arange(len(level)), best] = False
        whole = ~rivals.any(axis=1)
        np.add.at(sums, best[whole], np.column_stack([tree["total"][level[whole]], (tree["last"] - tree["first"])[level[whole]]]))
        for node, entry in zip(level[whole], best[whole]):
            codes[tree["first"][node]:tree["last"][node]] = entry
        open_ = level[~whole]
        leaves, inner = open_[tree["children"][open_] == 0], open_[tree["children"][open_] > 0]
        if len(leaves):
            count = tree["last"][leaves] - tree["first"][leaves]
            rows = np.repeat(tree["first"][leaves] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            codes[rows] = squared_distances(points[rows], entries).argmin(axis=1)
            np.add.at(sums, codes[rows], np.column_stack([points[rows], np.ones(len(rows), np.int64)]))
            compared += len(rows)
        count = tree["children"][inner]
        level = np.repeat(tree["child"][inner] - (np.cumsum(count) - count), count) + np.arange(count.sum()) if len(inner) else inner
    return codes, sums, compared


def borders(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


_NODE = ("first", "last", "child", "children")


def _packed(tree: dict[str, np.ndarray], points: np.ndarray) -> dict:
    packed = {"order": tree["order"].astype("<i4"), "points": points[tree["order"]].astype("<i4"), "centre": tree["centre"].astype("<i4"),
              "radius": tree["radius"].astype("<f8"), "total": tree["total"].astype("<i8")} | {c: tree[c].astype("<i4") for c in _NODE}
    return {name: value.tobytes() for name, value in packed.items()}


def _unpacked(stored: dict, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    flat = {c: np.frombuffer(stored[c], "<i4").astype(np.int64) for c in ("order", *_NODE)}
    nodes, rows = len(flat["first"]), len(flat["order"])
    tree = flat | {"radius": np.frombuffer(stored["radius"], "<f8"), "total": np.frombuffer(stored["total"], "<i8").astype(np.int64).reshape(nodes, width),
                   "centre": np.frombuffer(stored["centre"], "<i4").astype(np.int64).reshape(nodes, width)}
    return tree, np.frombuffer(stored["points"], "<i4").astype(np.int64).reshape(rows, width)


_TREE = "struct<order:binary,points:binary,centre:binary,radius:binary,total:binary,first:binary,last:binary,child:binary,children:binary>"
_TREE_TYPE = pa.struct([(c, pa.binary()) for c in ("order", "points", "centre", "radius", "total", *_NODE)])


def _grown(vectors: DataFrame, width: int, block: int) -> DataFrame:
    """row_ids and trees (one per part) of every block rows of a task; vectors has row_id and vector, integers of one width."""
    parts = borders(width)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            trees = [_packed(build_tree(values[:, a:b]), values[:, a:b]) for a, b in parts]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([trees], pa.list_(_TREE_TYPE))], names=["row_ids", "trees"])

        ids, values = np.empty(0, np.int64), np.empty((0, width), np.int64)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).flatten().to_numpy().reshape(-1, width)])
            while len(ids) >= block:
                yield made(ids[:block], values[:block])
                ids, values = ids[block:], values[block:]
        if len(ids):
            yield made(ids, values)

    return vectors.select("row_id", "vector").mapInArrow(grow, f"row_ids array<long>, trees array<{_TREE}>")


def _lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round. Each task sends a sum per entry and component; entries without points stay."""
    starts = np.cumsum([0, *[b.shape[0] * (b.shape[1] + 1) for b in books]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1], np.int64)
        for batch in batches:
            for stored in batch.column(0):
                for p, (tree, book) in enumerate(zip(stored.as_py(), books)):
                    total[starts[p]:starts[p + 1]] += assign(*_unpacked(tree, book.shape[1]), book)[1].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["slot", "total"])

    sums = np.zeros(starts[-1], np.int64)
    for row in blocks.select("trees").mapInArrow(add, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        sums[row.slot] = row.total
    after = []
    for p, book in enumerate(books):
        part = sums[starts[p]:starts[p + 1]].reshape(len(book), -1)
        used = part[:, -1:] > 0
        after.append(np.where(used, part[:, :-1] // np.maximum(part[:, -1:], 1), book))
    return after


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: a row per row of table whose vector is neither null nor holds
    null or non-finite components.

    Codebooks start as the parts of the rows with the smallest ids, null ids last and equal ids by their integers; with fewer rows
    they have fewer entries. The width is that of the first of these rows. Vectors of another width, or with components
    of 2^15 or more in size, take no part in learning and have null code and error. Widths that 8 does not divide have parts
    that differ by one component. label_error sums the errors of equal labels, nulls together. Repeated rows count each for
    itself, other columns take no part, an empty table gives an empty result."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = table.filter(v.isNotNull() & finite).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("vector"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialize(rows, "integers")
    fits = (F.size("vector") > 0) & F.forall("vector", lambda x: (x > -LIMIT) & (x < LIMIT))
    first = rows.filter(fits).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    width = sum(len(r.vector) for r in first.limit(1).collect())
    lead = first.filter(F.size("vector") == width).limit(entries).select("vector").collect()
    lead = np.array([r.vector for r in lead], np.int64).reshape(len(lead), width)
    books = [lead[:, a:b] for a, b in borders(width)]
    takes = fits & (F.size("vector") == width)
    blocks = materialize(_grown(rows.filter(takes), width, block), "cover-trees")
    for _ in range(rounds if width else 0):
        books = _lloyd_round(blocks, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, trees in zip(batch.column(0), batch.column(1)):
                ids = ids.values.to_numpy()
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, (stored, book) in enumerate(zip(trees.as_py(), books)):
                    tree, points = _unpacked(stored, book.shape[1])
                    found = assign(tree, points, book)[0]
                    codes[tree["order"], p] = found
                    error[tree["order"]] += ((points - book[found]) ** 2).sum(axis=1)
                shown = codes.tobytes().hex()
                size = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([shown[k:k + size] for k in range(0, len(shown), size)], pa.string()), pa.array(error)], names=["row_id", "code", "error"])

    coded = blocks.mapInArrow(encode, "row_id long, code string, error long")
    found = materialize(rows.drop("vector").join(coded, "row_id", "left"), "codes")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same_label")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("same_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
