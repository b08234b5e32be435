"""Arrow batches in pieces that stay small as Python objects."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

ROWS = 1000
_kept: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker from task to task, such as a vocabulary and its cache.

    A worker serves many stages; it keeps this for one operator at a time.
    """
    if name not in _kept:
        _kept.clear()
        gc.collect()
        _kept[name] = make()
    return _kept[name]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `rows` at a time; memory that Arrow keeps for later goes back at the end of a task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
