"""What a Python worker keeps from task to task, and gives back.

Spark hands a worker tasks of one stage after the other. Tables that speed up one stage
would lie beside the arrays of the next, so that the stages' memory would add up; tasks
of other stages that need much memory release them first.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_CLEARS: list[Callable[[], None]] = []


def kept(f):
    """f, a cached function, whose cache is emptied by release."""
    _CLEARS.append(f.cache_clear)
    return f


def release() -> None:
    """Forgets what this worker keeps; no result depends on it."""
    for clear in _CLEARS:
        clear()
    pa.default_memory_pool().release_unused()
