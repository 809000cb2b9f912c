"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words in every contract here.
SPACE = r"[\x20\x09-\x0D]+"


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids give fold -1, which is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(-1))


def let(value: Column, body) -> Column:
    """Bind value once for use many times in body: a lambda variable is evaluated once, a repeated expression is not."""
    return F.transform(F.array(value), body)[0]


_state: dict = {}


def worker_state(key, make):
    """What a Python worker keeps from task to task, made once for a key. Only one key's is held: workers outlive the
    stages of a job, and what an earlier stage left would add up."""
    if key not in _state:
        release()
        _state[key] = make()
    return _state[key]


def trim() -> None:
    """Give free memory back where Arrow's pool and the C library can: a worker would hold its largest batch for good."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release() -> None:
    """Forget what earlier stages left in this worker."""
    _state.clear()
    gc.collect()
    trim()


def trimmed(batches):
    """The batches, with free memory given back after each."""
    for batch in batches:
        yield batch
        trim()


def unused(name: str, columns: list[str]) -> str:
    """A column name like name that is not among columns."""
    while name in columns:
        name += "_"
    return name


def cut(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Stretches of an Arrow batch that hold about limit bytes of text each (a single longer text stays whole)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows:
        yield batch.slice(start)
