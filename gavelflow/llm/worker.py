"""What a Python worker keeps between tasks, and when it gives memory back.

Spark uses a worker for one stage after another. State that is worth keeping from task to task (caches,
models) belongs to an owner; when a task of another owner begins, it goes, so that the states of several
stages never add up. When a task ends, memory that nothing uses returns to the system.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Seconds between two returns of memory by tasks of one owner.
PAUSE = 2.0

_held: dict[tuple[str, str], object] = {}
_owner: str | None = None
_trimmed = 0.0


def enter(owner: str) -> None:
    """A task of this owner begins: other owners' state goes."""
    global _owner
    if _owner != owner:
        _owner = owner
        if _held:
            _held.clear()
        trim()


def held(owner: str, key: str, make: Callable[[], object]) -> object:
    """The owner's state of this key, made where it is not there."""
    enter(owner)
    if (owner, key) not in _held:
        _held[owner, key] = make()
    return _held[owner, key]


def trim(pause: float = 0.0) -> None:
    """Return unused memory to the system, unless that was done in the last pause seconds."""
    global _trimmed
    now = time.monotonic()
    if now - _trimmed < pause:
        return
    _trimmed = now
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the C library that has it


def batches(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that keeps to these rules."""

    def kept(rows: Iterator) -> Iterator:
        enter(owner)
        try:
            yield from run(rows)
        finally:
            trim(PAUSE)

    return kept


def groups(owner: str, run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow that keeps to them."""

    def kept(table: pa.Table) -> pa.Table:
        enter(owner)
        try:
            return run(table)
        finally:
            trim(PAUSE)

    return kept
