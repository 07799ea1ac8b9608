"""What Python workers keep between tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import Broadcast

A, B = TypeVar("A"), TypeVar("B")


def once(shared: Broadcast[A], build: Callable[[A], B]) -> B:
    """``build(shared.value)``, made once per Python worker: a worker keeps a broadcast as long as the driver does, and with it what was built."""
    out = getattr(shared, "_built", None)
    if out is None:
        out = shared._built = build(shared.value)
    return out
