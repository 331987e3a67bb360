"""Consecutive rows of one key, from the batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """One table for each run of rows that agree in `keys`. A run may span batches; only
    the one that is not yet complete is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        for key, at in groupby(range(len(own)), key=own.__getitem__):
            first = next(at)
            part = batch.slice(first, 1 + sum(1 for _ in at))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield pa.Table.from_batches(held)
