"""Packing of tokenised documents into sequences by bounded-space best fit.

Documents are tokenised where they are read; only lengths, checksums and, if asked for, ids travel. A fixed number of
open sequences is kept in a bitset indexed by free space: the lowest set bit at or above a piece's length is its best fit.
When one more is open than allowed, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm import byte_bpe
from factloom.plans.session import materialize

CAPACITY = 1024
END = 2  # the id that ends each document
OPEN = 256  # open sequences of a task
PIECES = 32768  # pieces packed by one task


def cut_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
               end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows of docs -> doc_id, piece, start, length, ids_crc32 (and ids, little-endian bytes): each document's ids and the
    end id, cut into pieces of `capacity`, of which the first takes the rest.

    Names of the vocabulary's special tokens in a text are those tokens. Null and empty texts are the end id alone. Repeated
    rows are tokenised each for itself; other columns take no part."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        *([("ids", pa.binary())] if with_ids else [])])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_bpe.load(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = vocabulary.ids(body.as_py() or "")
                ids.append(end)
                cut = (len(ids) - 1) % capacity + 1
                for piece, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], range(cut, len(ids) + 1, capacity))):
                    part = byte_bpe.little_endian(ids[a:b])
                    for column, value in zip(rows, (key, piece, a, b - a, zlib.crc32(part), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, ddl)


class BestFit:
    """Places lengths one after the other; open sequences are stacks by free space, found through a bitset."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open, self.mask, self.open, self.made = capacity, most_open, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.by_space[space].pop()
        self.open -= 1
        if not self.by_space[space]:
            self.mask &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to capacity tokens."""
        fitting = self.mask >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.capacity, self.made
            self.made += 1
        if space > length:
            self.by_space[space - length].append(sequence)
            self.mask |= 1 << (space - length)
            self.open += 1
            if self.open > self.most_open:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return sequence, self.capacity - space


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, task_pieces: int = PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces (a table with a length of 1 to capacity).

    Pieces are dealt round-robin to tasks of about task_pieces, so no key can gather in one; each task packs in the order of
    the checksum, which is as good as random and the same when a lost task runs again. Empty tables give empty results."""
    tasks = max(1, -(-pieces.count() // task_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks).sortWithinPartitions("ids_crc32", "doc_id", "piece")
    return dealt.mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece. The pieces are stored once, so that nothing is tokenised again."""
    return pack(materialize(cut_pieces(docs, tokenizer, doc_id, text, with_ids=with_ids), "pieces"))
