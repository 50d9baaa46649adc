"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles, hashed to 64 bits and ordered by hash, frequent ones later. Two sets that are
similar enough share a shingle among their first few. Documents with identical prefixes and size form one group; groups that
share a prefix shingle are paired and filtered by size and position, then expanded to their documents. Parity bitmaps rule
out most pairs; what stays is joined into presumed components, inside which whole sets are compared.

No step lists all pairs of a large group: groups and very common shingles are dealt out in tiles, large components are
compared with a few representatives first, and no tile reports more links than it takes to connect its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factloom.llm.cells import by_cell, cells
from factloom.llm.components import components
from factloom.plans.session import materialize

COMMON = 64  # a shingle in more prefixes than this is common: it goes later in the order, and its documents into tiles
MOST_COMMON = 1 << 20  # shingles moved back at most; any choice of them gives the same result
MAP_TILE = 4096  # documents of a tile when bitmaps are compared, a few hundred bytes each
TEXT_TILE = 256  # and when whole texts are
REPRESENTATIVES = 8  # members of a large component that all others meet first
SLICE = 1000  # rows whose sketches are made together
KNOWN = 200_000  # words whose hashes a worker remembers before it starts anew

_A, _B, _C = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


@dataclass(frozen=True)
class Similarity:
    """Linked: 100 * intersection >= percent * union, on sets of `words`-word shingles."""

    words: int = 3
    percent: int = 90

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. ASCII letters are lower-cased; words lie between ASCII white space. Fewer words than a
        shingle has count as one shingle; no word, no shingle."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
        count = min(self.words, len(found))
        mixed = np.full(len(found) - count + 1, count, np.uint64)
        for k in range(count):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ each[k:len(found) - count + 1 + k]) * _A + _C
        mixed ^= mixed >> np.uint64(32)
        mixed *= _B
        return np.unique(mixed ^ (mixed >> np.uint64(29)))

    def overlap(self, a, b):
        """Least intersection of linked sets of a and b shingles."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """How many first shingles of n must be looked at."""
        return n - -(-self.percent * n // 100) + 1

    @property
    def back(self) -> int:
        """How far a common shingle is moved back, in hash values: about as far as prefixes reach."""
        return (1 << 64) // 100 * (100 - self.percent)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits, in a power of two of bits of at least their number. Each shingle in which two
    sets differ flips one bit, so the bits that differ never outnumber them."""
    bits = max(64, 1 << int(len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(value: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(value, np.uint64)
    while len(words) * 8 > size:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


class Links:
    """Union of numbered members."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self, nodes: np.ndarray) -> pa.RecordBatch:
        """Pairs (x, y) of each member's least fellow node and its own: whatever is joined is two steps apart at most."""
        roots = np.array([self.root(k) for k in range(len(nodes))], np.int64)
        centres = np.lexsort((nodes, roots))
        centres = centres[np.concatenate([[True], np.diff(roots[centres]) > 0])]
        centre = np.empty(len(nodes), np.int64)
        centre[roots[centres]] = centres
        outer = np.flatnonzero(centre[roots] != np.arange(len(nodes)))
        pairs = nodes[centre[roots[outer]]], nodes[outer]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], names=["x", "y"])


def tiles(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of each key dealt to cells of at most about two tiles, so that any two rows of a key meet in a cell.

    A key of up to two tiles is one cell; larger ones are split by a hash of node, and each row goes to one cell per tile."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    parts = F.when(F.col("members") <= 2 * size, 1).otherwise(F.ceil(F.col("members") / size)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    split = rows.join(counts, key).withColumn("parts", parts).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # with one other tile a cell is a pair of tiles; the tile by itself is part of each of them
    split = split.filter("parts = 1 OR own <> other")
    cell = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    return split.withColumn("cell", cell).drop("members", "parts", "own", "other")


def sketches(docs: DataFrame, doc_id: str, text: str, like: Similarity) -> DataFrame:
    """A row per row of docs: doc_id, key (a hash of id and text), n, two set signatures, bitmap, and the hashes up to
    `back` beyond the prefix."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n, one, two, bits, first = [], [], [], [], []
            for body in batch.column(2):
                s = like.shingles(body.as_py())
                n.append(len(s))
                raw = s.tobytes()
                one.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                two.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                bits.append(bitmap(s) if len(s) else b"")
                limit = min(int(s[like.prefix(len(s)) - 1]) + like.back, (1 << 64) - 1) if len(s) else 0
                first.append(s[:np.searchsorted(s, np.uint64(limit), "right")].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "s1", "s2", "bitmap", "first"])

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return keyed.mapInArrow(sketch, "doc_id long, key long, n int, s1 long, s2 long, bitmap binary, first array<long>")


def _key(doc_id: str, text: str):
    """Names a row's text; rows that share an id but not their text have keys of their own."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def ordered(rows: DataFrame, common: np.ndarray, like: Similarity) -> DataFrame:
    """Sketches with group (hash of size and prefix), prefix and which of it is common instead of `first`: the first
    shingles when common ones stand `back` later. Whatever lies beyond the stored hashes comes
    later than those."""
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(common))
    columns = ["key", "doc_id", "n", "s1", "s2", "bitmap"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, firsts, often = [], [], []
            for n, first in zip(batch.column("n").to_pylist(), batch.column("first")):
                s = first.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(shared.value, s), max(len(shared.value) - 1, 0))
                is_common = shared.value[at] == s if len(shared.value) else np.zeros(len(s), bool)
                place = (s >> np.uint64(1)) + is_common.astype(np.uint64) * np.uint64(like.back >> 1)
                chosen = np.lexsort((s, place))[:like.prefix(n)]
                groups.append(xxhash.xxh64_intdigest(s[chosen].tobytes(), n) - (1 << 63))
                firsts.append(s[chosen].view(np.int64))
                often.append(is_common[chosen])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(groups, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                 pa.array(often, pa.list_(pa.bool_()))], names=[*columns, "group", "prefix", "common"])

    ddl = "key long, doc_id long, n int, s1 long, s2 long, bitmap binary, group long, prefix array<long>, common array<boolean>"
    return rows.select(*columns, "first").mapInArrow(order, ddl)


def presumed_in_tiles(rows: DataFrame, like: Similarity) -> DataFrame:
    """rows (key, node, n, bitmap) -> pairs (x, y) of nodes that links which their bitmaps allow connect within a cell, as few as connect them."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            n = table.column("n").to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            n, nodes = n[order], table.column("node").to_numpy()[order]
            maps = [table.column("bitmap")[int(k)].as_py() for k in order]
            sizes = np.array([len(m) for m in maps])
            folded = {}
            for size in np.unique(sizes).tolist():
                rows_of = np.flatnonzero((sizes == size) | (sizes == 2 * size))
                folded[size] = (rows_of[0], np.stack([_fold(maps[k], size) for k in rows_of]))
            links = Links(len(n))
            for k in range(len(n) - 1):
                end = int(np.searchsorted(n, n[k] * 100 // like.percent, "right"))
                if end > k + 1:
                    start, matrix = folded[int(sizes[k])]
                    differ = np.bitwise_count(matrix[k + 1 - start:end - start] ^ matrix[k - start]).sum(axis=1)
                    both = n[k] + n[k + 1:end]
                    for other in np.flatnonzero(differ <= both - 2 * like.overlap(n[k], n[k + 1:end])).tolist():
                        links.join(k, k + 1 + other)
            yield links.stars(nodes)

    return by_cell(tiles(rows, "key", MAP_TILE), "node", "n", "bitmap").mapInArrow(compare, "x long, y long")


def presumed_pairs(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Pairs (x, y) whose bitmaps allow a link."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m"))):
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
                keep.append(differ <= n + m - 2 * like.overlap(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("x"), F.col("n"), F.col("bitmap").alias("a"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("m"), F.col("bitmap").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b", "n", "m").mapInArrow(compare, "x long, y long")


def linked_members(texts: DataFrame, like: Similarity) -> DataFrame:
    """texts (key, node, text): pairs (x, y) within each key that links connect, enough to connect whatever links connect.

    Keys of up to two tiles are compared whole. In larger ones every member first meets a few members chosen by hash, the
    representatives, and the others of its tile: in a group of near copies that links all, for one copy of each text.
    Where several classes are left, the members outside the largest class meet everybody: all of them in tiles, and each tile
    of them every tile of the largest class."""
    sizes = materialize(texts.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(REPRESENTATIVES)])).alias("chosen"),
    ).filter(F.col("members") > 2 * TEXT_TILE).withColumn("parts", F.ceil(F.col("members") / TEXT_TILE).cast("int")), "large-components")
    small = tiles(texts.join(sizes.select("key"), "key", "left_anti"), "key", TEXT_TILE).select("cell", "node", "text")
    if sizes.isEmpty():
        return verified_links(small, like)
    large = materialize(texts.join(sizes.select("key", "parts"), "key"), "large-bodies")
    chosen = sizes.select("key", F.explode("chosen").alias("node")).join(large, ["key", "node"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).unionByName(chosen.withColumn("part", every("parts")))
    first = verified_links(dealt.withColumn("cell", F.xxhash64("key", "part")), like)

    classed = large.select("key", "node").join(components(first).withColumnRenamed("label", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    classes = materialize(classed, "classes")
    met = classes.filter("class <> node").select(F.col("class").alias("x"), F.col("node").alias("y"))
    counts = classes.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("n", "class")).alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.max("n").alias("most"))
    main = materialize(main.filter("classes > 1").select("key", "main", *[F.ceil(F.col(c) / TEXT_TILE).cast("int").alias(f"{c}_parts") for c in ("others", "most")]), "mixed-components")
    if main.isEmpty():
        return verified_links(small, like).unionByName(met)
    mixed = large.drop("parts").join(classes, ["key", "node"]).join(main, "key").withColumn("in_main", F.col("class") == F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.col(n)).cast("int")
    inside = mixed.filter("in_main").withColumn("b", own("most_parts")).withColumn("s", every("others_parts"))
    outside = mixed.filter("NOT in_main").withColumn("s", own("others_parts")).withColumn("b", every("most_parts"))
    across = inside.unionByName(outside).withColumn("cell", F.xxhash64("key", "s", "b", F.lit("across")))
    apart = tiles(mixed.filter("NOT in_main").select("key", "node", "text"), "key", TEXT_TILE)
    rest = [df.select("cell", "node", "text") for df in (across, apart)]
    return verified_links(small.unionByName(rest[0]).unionByName(rest[1]), like).unionByName(met)


def verified_links(dealt: DataFrame, like: Similarity) -> DataFrame:
    """dealt (cell, node, text): whole sets are compared within each cell -> pairs (x, y) that links connect, as few as connect them."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            nodes = table.column("node").to_numpy()
            found = [like.shingles(t.as_py()) for t in table.column("text")]
            size = np.array([len(s) for s in found])
            tokens, owners = np.concatenate(found), np.repeat(np.arange(len(found)), size)
            by_token = np.argsort(tokens, kind="stable")
            ranks = np.empty(len(tokens), np.int64)
            fresh = np.concatenate([[True], tokens[by_token][1:] != tokens[by_token][:-1]])
            ranks[by_token] = np.cumsum(fresh) - 1
            starts = np.append(np.flatnonzero(fresh), len(tokens))
            postings, ends = owners[by_token], np.cumsum(size)
            links = Links(len(found))
            for k in range(len(found)):
                own = ranks[ends[k] - size[k]:ends[k]]
                counts = starts[own + 1] - starts[own]
                at = np.repeat(starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                both = np.bincount(postings[at], minlength=len(found))
                for other in np.flatnonzero(100 * both >= like.percent * (size + size[k] - both)).tolist():
                    if other > k:
                        links.join(k, other)
            yield links.stars(nodes)

    return by_cell(dealt, "node", "text").mapInArrow(compare, "x long, y long")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", like: Similarity = Similarity(), common: int = COMMON) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Null, empty and blank texts have no shingles, link with nothing and are their own component. Equal sets are linked. Each
    row is a document of its own: texts are linked by what they hold, not by an id they share. Rows without an id are linked
    like others, but name no component (null if none of it has an id). Other columns take no part; an empty table gives an
    empty result."""
    return _keyed_components(docs, doc_id, text, like, common).drop("key")


def _keyed_components(docs: DataFrame, doc_id: str, text: str, like: Similarity, common: int = COMMON) -> DataFrame:
    """The rows of :func:`similar_components`, with their keys."""
    rows = materialize(sketches(docs, doc_id, text, like), "sketches")

    # the order: shingles that many prefixes hold go later
    some = rows.filter("n > 0")
    often = (
        some.select(F.explode(F.slice("first", 1, (F.col("n") - F.ceil(F.col("n") * like.percent / 100) + 1).cast("int"))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > common).orderBy(F.desc("df"), "token").limit(MOST_COMMON))
    known = np.fromiter((r.token for r in often.toLocalIterator()), np.int64).view(np.uint64)

    # documents with one set count once; sets of identical size and prefix form a group
    placed = materialize(ordered(some, known, like), "prefixes")
    sets = materialize(
        placed.groupBy("n", "s1", "s2").agg(
            F.min("key").alias("node"), F.min("doc_id").alias("least_id"), F.any_value("bitmap").alias("bitmap"), F.any_value("group").alias("group")), "sets")
    sizes = sets.groupBy("n", "group").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("members"))
    shapes = placed.groupBy("n", "group").agg(F.any_value("prefix").alias("prefix"), F.any_value("common").alias("common"))
    groups = materialize(shapes.join(sizes, ["n", "group"]), "groups")
    of_group = materialize(
        sets.select("node", "n", "group").join(groups.filter("members > 1").select("n", "group", "gid"), ["n", "group"]).select("node", "n", "gid"), "members")
    tokens = groups.select("gid", "n", "members", F.posexplode(F.arrays_zip("prefix", "common")).alias("place", "t")).select(
        "gid", "n", "members", "place", F.col("t.prefix").alias("token"), F.col("t.common").alias("common"))
    # shingles that came into prefixes because others went later may be common too, and so may those beyond MOST_COMMON
    late = (
        tokens.filter("NOT common").groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > common)
        .select("token", F.lit(True).alias("late")))
    tokens = tokens.join(materialize(late, "late"), "token", "left").withColumn("common", F.col("common") | F.coalesce("late", F.lit(False)))
    rare = tokens.filter(~F.col("common"))

    # pairs of groups, filtered by size and by the place of the shared shingle
    a, b = rare.alias("a"), rare.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    reach = F.least(n - F.col("a.place"), m - F.col("b.place"))
    need = F.ceil((n + m) * like.percent / (100 + like.percent))
    met = a.join(b, "token").filter(
        ((n < m) | ((n == m) & (F.col("a.gid") < F.col("b.gid")))) & (n * 100 >= m * like.percent) & (reach >= need))
    pairs = materialize(met.select(F.col("a.gid").alias("x"), F.col("b.gid").alias("y"), (F.col("a.members") + F.col("b.members") == 2).alias("single")).distinct(), "pairs")

    # expansion: pairs of single documents directly, everything else in tiles of documents
    single = presumed_pairs(pairs.filter("single").select("x", "y"), sets, like)
    alone = groups.filter("members = 1").select(F.col("gid").alias("node"), "n", "gid")
    everyone = of_group.unionByName(alone)
    larger = pairs.filter("NOT single").select(F.xxhash64("x", "y").alias("key"), F.explode(F.array("x", "y")).alias("gid"))
    common_rows = tokens.filter("common").select(F.col("token").alias("key"), "gid")
    in_tiles = larger.union(common_rows).join(everyone, "gid").select("key", "node").union(
        of_group.select(F.xxhash64("gid", F.lit(2)).alias("key"), "node"))
    tiled = presumed_in_tiles(materialize(in_tiles.join(sets.select("node", "n", "bitmap"), "node"), "tiles"), like)

    # whole sets, inside the presumed components
    presumed = components(single.union(tiled))
    bodies = docs.select(_key(doc_id, text).alias("node"), F.col(text).alias("text")).join(presumed, "node").select(F.col("label").alias("key"), "node", "text")
    linked = components(linked_members(materialize(bodies, "bodies"), like))
    named = linked.join(sets.select("node", "least_id"), "node")
    names = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_sets = materialize(
        sets.select("n", "s1", "s2", "node", "least_id").join(named.join(names, "label").select("node", "component_id"), "node", "left")
        .select("n", "s1", "s2", F.coalesce("component_id", "least_id").alias("component_id")), "components")
    return rows.join(of_sets, ["n", "s1", "s2"], "left").select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", like: Similarity = Similarity()) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id names their component. Rows without an id stay."""
    found = _keyed_components(docs, doc_id, text, like)
    dropped = materialize(found.filter("doc_id <> component_id").select("doc_id", "key").distinct(), "near-copies")
    same = (F.col(f"docs.{doc_id}").cast("long") == F.col("dropped.doc_id")) & (_key(f"docs.{doc_id}", f"docs.{text}") == F.col("dropped.key"))
    return docs.alias("docs").join(dropped.alias("dropped"), same, "left_anti")
