"""Streaming through tasks cell by cell, without a call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_cell(rows: DataFrame, *columns: str) -> DataFrame:
    """cell and the columns, the rows of a cell one after the other in one task."""
    return rows.select("cell", *columns).repartition("cell").sortWithinPartitions("cell")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which is sorted within the task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        borders = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for start, end in zip(borders, borders[1:]):
            if held and held[0].column(0)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
