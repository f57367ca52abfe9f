"""Python workers serve many stages; what one stage has freed goes back to the machine before the next begins."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


@functools.lru_cache(maxsize=1)
def _allocator():
    """The C library, with Arrow's buffers in its care; None where it can't give memory back."""
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim(0)
    except (AttributeError, OSError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def give_back() -> None:
    """Free memory that nothing refers to, and return it."""
    gc.collect()
    if libc := _allocator():
        libc.malloc_trim(0)


def lean(stage):
    """A function over record batches as it is, with its memory given back when its task ends."""

    def run(stream):
        _allocator()
        try:
            yield from stage(stream)
        finally:
            give_back()

    return run
