"""Rows of one key together in a task, many keys at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 20_000
BYTES = 8 << 20


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task, one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def borders(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each group of consecutive rows with the same keys begins, and the end."""
    change = np.zeros(len(table), bool)
    for key in keys:
        values = table[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(table)]])


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the borders of the groups, from rows that come `together`.

    A table is given out at some thousand rows or some MB; a larger group alone.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows < ROWS and size < BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        found = borders(table, keys)
        last = int(found[-2])
        if last:
            yield table.slice(0, last), found[:-1]
        held = pa.Table.from_batches(table.slice(last).to_batches()).combine_chunks().to_batches()
        rows, size = len(table) - last, sum(b.nbytes for b in held)
        if not last:  # one group so far: look again when it has doubled
            rows, size = rows // 2, size // 2
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, borders(table, keys)
