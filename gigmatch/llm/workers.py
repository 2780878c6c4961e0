"""What Python workers hold between tasks, how they give memory back (they outlive tasks and stages), and how much they work on at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gigmatch.llm.common import slices

#: Bytes of a batch that are worked on at once; the words, hashes and counts made of them take a multiple of that.
STEP = 1 << 19

_HELD: dict[str, object] = {}

Batches = Iterator[pa.RecordBatch]


def held(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in a worker from one batch to the next: the tables of one operator at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget(but: str | None = None) -> None:
    """Drops what is held, unless its key begins with ``but``."""
    for key in [k for k in _HELD if but is None or not k.startswith(but)]:
        del _HELD[key]


def give_back() -> None:
    """Returns freed memory to the system, which allocators otherwise keep for the worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library; memory stays with the worker
        pass


def cut(batches: Batches, most: int = STEP) -> Batches:
    """The rows of ``batches`` in their order, in batches of about ``most`` bytes, of one row at least; none is copied."""
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        sizes += max(batch.nbytes - int(sizes.sum()), 0) // batch.num_rows  # the other columns
        for start, end in slices(sizes.tolist(), most):
            yield batch.slice(start, end - start)


def lean(run: Callable[[Batches], Batches], but: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` over batches cut small that lets go of other operators' tables (keys that don't begin with ``but``) first,
    and of freed memory at its end."""

    def whole(batches: Batches) -> Batches:
        forget(but)
        try:
            yield from run(cut(batches))
        finally:
            give_back()

    return whole
