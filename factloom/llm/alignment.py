"""Alignment of two tokenizations of each text: groups of tokens that cover the same bytes, and how often ids are linked.

The ends of A and B tokens are two ascending lists of byte offsets. Their merge is divided on diagonals: the cut of a diagonal
is found by binary search, so every piece has the same number of ends, whatever documents it spans. A piece looks only at
its own ends and emits those where an A and a B token both end. What a piece leaves open at its borders is stitched to
its neighbours: a group is what lies between two emitted ends. Links are counted by id pair over all documents, and each
document's links are looked up in those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm import byte_bpe
from factloom.plans.session import materialize

WORK = 1 << 16  # ends of a piece
TEXT_BYTES = 1 << 21  # text aligned at once; a longer document stands alone
LINKS = 1 << 22  # links listed at once
BROADCAST_PAIRS = 1 << 20  # up to so many id pairs their counts go to every task; beyond, they are joined by shuffle
TIMES_BITS = 31  # of a packed link; the rest is the id pair


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (i, j), from (0, 0) to (len(a), len(b)), of the merge of two ascending lists into pieces of about `work` entries.

    All diagonals i + j = work, 2 * work, ... are searched at once. Of equal entries a's comes first, and a cut that would part
    them takes b's as well."""
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        # does a[i] come before b[diagonal - i - 1]?
        before = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(diagonal - i - 1, 0, len(b) - 1)])
        low, high = np.where(before, i + 1, low), np.where(open_ & ~before, i, high)
    i, j = low, diagonal - low
    if len(a) and len(b):
        j = j + ((i > 0) & (j < len(b)) & (a[i - 1] == b[np.minimum(j, len(b) - 1)]))
    return i, j


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the entries that both hold: the work of one piece. Both are strictly ascending but for tokens
    without bytes, of which the last counts."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.append(a[1:] != a[:-1], True)
    there = np.searchsorted(b, a, side="right") - 1
    i = np.flatnonzero(last & (there >= 0) & (b[np.maximum(there, 0)] == a))
    return i, there[i]


def groups(a_ends: np.ndarray, b_ends: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Last A token and last B token of each group, piece by piece."""
    cut_a, cut_b = merge_path(a_ends, b_ends, work)
    found = [(i + i0, j + j0) for i0, i1, j0, j1 in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])
             for i, j in [common_ends(a_ends[i0:i1], b_ends[j0:j1])]]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


class Vocabularies:
    """Both tokenizers of a worker, the bytes and lengths of their tokens, and every id as text before each separator."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = byte_bpe.load(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(self.a.token_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a.token_bytes, b_bytes))
        self.shown = pa.array([f"{i}{mark}" for i in range(max(len(self.a_lengths), len(b_bytes))) for mark in (",", "|", ";", "")], pa.large_binary())
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)  # no token goes on beyond a space

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids; None for null and empty texts and where either's bytes are not those of the text."""
        if not text:
            return None
        a_parts, b_parts = [], []
        # long texts in parts that both vocabularies tokenise alone as they do together; each starts with a space
        for part in byte_bpe.safe_parts(" " + text) if self.apart and self.a.fast else [" " + text]:
            a, b = np.array(self.a.ordinary(part), np.int32), np.array(self.b.encode(part[1:]), np.int32)
            whole = part.encode()
            if any(_joined(t.take(pa.array(i))) != whole for t, i in ((self.a_bytes, a), (self.b_bytes, b))):
                return None
            a_parts.append(a)
            b_parts.append(b)
        return np.concatenate(a_parts), np.concatenate(b_parts)


def _joined(values: pa.Array) -> bytes:
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset:][:len(values) + 1]
    return values.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if len(values) and values.buffers()[2] is not None else b""


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def _vocabularies(*paths: str) -> Vocabularies:
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their times (1 each if not given)."""
    if times is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


def _links(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, group_key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys group_key + a id * width + b id over all pairs of tokens of a group, and how many pairs have each.

    At most LINKS pairs are listed at once; a group of more is counted by its distinct ids."""
    made, found = a_size * b_size, []
    a_start, b_start = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
    for g in np.flatnonzero(made > LINKS):
        (a_ids, m), (b_ids, n) = _counted(a[a_start[g]:][:a_size[g]].astype(np.int64)), _counted(b[b_start[g]:][:b_size[g]].astype(np.int64))
        found.append(((group_key[g] + a_ids[:, None] * width + b_ids).ravel(), (m[:, None] * n).ravel()))
    small = np.flatnonzero(made <= LINKS)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(made[small]) // LINKS)) + 1):
        per_a = np.repeat(b_size[part], a_size[part])
        a_at = np.repeat(a_start[part] - (np.cumsum(a_size[part]) - a_size[part]), a_size[part]) + np.arange(a_size[part].sum())
        left = np.repeat(np.repeat(group_key[part], a_size[part]) + a[a_at].astype(np.int64) * width, per_a)
        first = np.repeat(b_start[part], a_size[part]) - (np.cumsum(per_a) - per_a)
        found.append(_counted(left + b[np.repeat(first, per_a) + np.arange(len(left))]))
    return found[0] if len(found) == 1 else _counted(*map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 2


def align(vocabularies: Vocabularies, texts: list[str | None], work: int = WORK) -> list[dict]:
    """Per text: n_a, n_b, n_groups, n_links, groups (as text), pairs (a id * size of B + b id, distinct, ascending) and times.

    Texts without tokens have zeros and an empty text."""
    tokens = [vocabularies.tokens(t) for t in texts]
    made = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": b"", "pairs": np.empty(0, np.int64), "times": np.empty(0, np.int64)} for _ in texts]
    having = [k for k, t in enumerate(tokens) if t is not None]
    if not having:
        return made
    a, b = (np.concatenate([tokens[k][side] for k in having]) for side in (0, 1))
    a_last, b_last = (np.cumsum([len(tokens[k][side]) for k in having]) for side in (0, 1))
    # every text ends at the same offset in both lists, so no group crosses it
    close_a, close_b = groups(np.cumsum(vocabularies.a_lengths[a]), np.cumsum(vocabularies.b_lengths[b]), work)
    a_size, b_size = np.diff(close_a, prepend=-1), np.diff(close_b, prepend=-1)
    group_last = np.searchsorted(close_a, a_last)  # groups before the end of each text
    group_text = np.searchsorted(a_last, close_a, side="right")
    # the text of all groups: tokens in order, each with its separator
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[close_a], mark_b[close_b] = 1, 2
    mark_b[b_last - 1] = 3
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + np.repeat(close_b + 1 - b_size, a_size)] = a.astype(np.int64) * 4 + mark_a
    shown[np.arange(len(b)) + np.repeat(close_a + 1, b_size)] = b.astype(np.int64) * 4 + mark_b
    text = vocabularies.shown.take(pa.array(shown))
    offsets = np.frombuffer(text.buffers()[1], np.int64)
    body = memoryview(text.buffers()[2])
    width = len(vocabularies.b_lengths)
    span = len(vocabularies.a_lengths) * width
    keys, times = _links(a, b, a_size, b_size, group_text * span, width)
    key_last = np.searchsorted(keys, (np.arange(len(having)) + 1) * span)
    products = np.append(0, np.cumsum(a_size * b_size))
    start = [0, 0, 0, 0]
    for n, k in enumerate(having):
        end = [int(a_last[n]), int(b_last[n]), int(group_last[n]), int(key_last[n])]
        size = [y - x for x, y in zip(start, end)]
        made[k] = {
            "n_a": size[0], "n_b": size[1], "n_groups": size[2], "n_links": int(products[end[2]] - products[start[2]]),
            "groups": bytes(body[offsets[start[0] + start[1]]:offsets[end[0] + end[1]]]),
            "pairs": keys[start[3]:end[3]] - n * span, "times": times[start[3]:end[3]]}
        start = end
    return made


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Row by row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (and groups, if asked for).

    links holds an entry per distinct linked id pair, (a id * size of B's vocabulary + b id) << TIMES_BITS | times linked. A
    null or empty text, and one whose tokens do not give back its bytes, has zeros, '' and no links. Other columns take no part."""
    fields = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64())),
              *([("groups", pa.string())] if with_groups else [])]

    def batch_of(keys: list, texts: list) -> pa.RecordBatch:
        made = align(_vocabularies(a_path, b_path), texts)
        links = [m["pairs"] << TIMES_BITS | m["times"] for m in made]
        columns = [
            pa.array(keys, pa.int64()), *[pa.array([m[c] for m in made], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
            pa.array([hashlib.sha256(m["groups"]).hexdigest() if m["n_a"] else "" for m in made]),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, links)]), pa.int32()), pa.array(np.concatenate(links), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns + [pa.array([m["groups"].decode() for m in made])] * with_groups, schema=pa.schema(fields))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                if texts and size + len(body or "") > TEXT_BYTES:
                    yield batch_of(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(body)
                size += len(body or "")
            if texts:
                yield batch_of(keys, texts)

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>" + ", groups string" * with_groups
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(aligned, ddl)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id, ties included).

    Counted by partial sums, so a pair that every document holds costs a row per task. An A id has at most `width` pairs."""
    pairs = aligned.select(F.explode("links").alias("link")).select(F.shiftright("link", TIMES_BITS).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair DIV {width}"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def linked_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row of docs.

    n_best are the links whose id pair is held by as many documents as any pair of its A id; count_sum adds the counts of all
    links. Repeated rows and rows without id are documents of their own; an empty table gives an empty result. The counts
    are sent to all tasks where there are at most `broadcast_pairs`, else joined by pair, popular ones split by adaptive execution."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    found = materialize(align_documents(docs, a_path, b_path, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(found, width), "pair-counts")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = found.select("row", F.explode("links").alias("link")).select(
        "row", F.shiftright("link", TIMES_BITS).alias("pair"), F.col("link").bitwiseAND((1 << TIMES_BITS) - 1).alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
