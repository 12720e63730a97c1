"""Tables that a Python worker keeps between tasks: only the operator that runs now keeps one."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """Say that ``name`` keeps a table from now on; what others keep is released."""
    if name not in _held:
        for other in list(_held):
            _held.pop(other)()
        give_back()
        _held[name] = release


def give_back() -> None:
    """Freed memory of this process goes back to the system, as an executor counts what its workers hold, and the driver its Python; where the C library has no call for it, it stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return
