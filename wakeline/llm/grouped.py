"""Rows of sorted Arrow batches, group by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], key: int = 1) -> Iterator[list[tuple]]:
    """Lists of rows (tuples of ``names``) that agree in their first ``key`` columns.

    Batches must be sorted by those; a group may reach over several batches.
    """
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:key] != now:
                if held:
                    yield held
                now, held = row[:key], []
            held.append(row)
    if held:
        yield held
