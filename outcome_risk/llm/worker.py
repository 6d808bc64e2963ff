"""What a Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: list[tuple[str, Any, Any]] = []


def release() -> None:
    """Drop what is kept and hand its memory back, so that the next operator can use it."""
    if not _kept:
        return
    _kept.clear()
    gc.collect()  # encoders refer to themselves, so counting references does not free them
    trim()


def trim() -> None:
    """Hand freed memory back to the system, Arrow's own too."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def keep(kind: str, source: Any, build: Callable[[], Any]) -> Any:
    """What ``build`` makes of ``source``, kept for the worker's next tasks.

    A worker serves tasks of different stages in turn. What it kept for another kind, or
    another source, is released first: two operators never hold their tables together.
    """
    if not _kept or _kept[0][0] != kind or _kept[0][1] is not source:
        release()
        _kept.append((kind, source, build()))
    return _kept[0][2]
