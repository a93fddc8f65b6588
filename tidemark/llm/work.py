"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tidemark.operators.storage import shared_folder, small_or_not
from tidemark.operators.storage import stored as written

__all__ = ["shared_folder", "small_or_not", "unused", "whole_groups", "written"]


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores behind it as long as a column has it, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the named columns in tables of whole groups, and the groups' starts; holds one group more than a batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        starts = _starts(rows.select(names))
        if starts[-1]:
            yield rows.slice(0, starts[-1]).combine_chunks(), starts[:-1]
        rest = rows.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.array([0])


def _starts(keys: pa.Table) -> np.ndarray:
    change = np.zeros(keys.num_rows, dtype=bool)
    change[0] = True
    for column in keys.columns:
        x = column.to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)
