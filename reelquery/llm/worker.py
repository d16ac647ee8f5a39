"""What a Python worker holds in memory, within a task and from one task to the next.

Spark keeps workers and deals them tasks of any operator, so what each operator remembered would add up in every worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: dict[object, object] = {}


def remembered(name: object, make: Callable[[], object]):
    """What is remembered by that name, made if it isn't there; what stood by any other name goes first, so a worker has the memory of one operator."""
    if name not in _HELD:
        forget()
        _HELD[name] = make()
    return _HELD[name]


def forget() -> None:
    """Drops what is held and gives free memory back to the system."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; its worker holds nothing when the task is over."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()

    return own
