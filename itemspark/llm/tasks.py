"""Helpers of functions that run batch by batch inside tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_ROWS = 512            # rows of a batch that are turned into Python objects at once


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column, a slice at a time, so that a batch of long texts
    isn't held twice."""
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(rows: DataFrame, names: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on rows whose columns called like its own ``names`` have other names
    meanwhile and get theirs back in the result."""
    own = {n.lower() for n in names}
    moved = {c: unused(f"aside{i}", [*rows.columns, *names]) for i, c in enumerate(rows.columns) if c.lower() in own}
    if not moved:
        return work(rows)
    return work(rows.withColumnsRenamed(moved)).withColumnsRenamed({new: c for c, new in moved.items()})


def remembered(key, make: Callable[[], object]):
    """An object that lives as long as the Python worker, for the tasks after this one;
    a new one is made for each ``key``, which must name all that it depends on."""
    store = sys.modules.setdefault("itemspark_worker_objects", types.ModuleType("itemspark_worker_objects")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return memory that is free again to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # not in every C library
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back at the end of a task: Python workers live on and
    serve other stages."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return wrapped
