"""Words, slices of batches and the one word table of a worker process."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterator

import pyarrow as pa

#: A word: a run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Arrow batches are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20


#: Spark's rows of an Arrow batch by default, and here, where rows hold texts.
DEFAULT_ROWS, TEXT_ROWS = "10000", "2000"
#: Spark's bytes of such a batch by default, and here.
DEFAULT_BYTES, TEXT_BYTES = "67108864", "8388608"


def text_batches(spark) -> None:
    """Have the session send fewer texts to Python at a time, unless it was set
    up otherwise; executors hold a batch of each task several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(key, TEXT_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, DEFAULT_BYTES).rstrip("b") == DEFAULT_BYTES:
        spark.conf.set(key, TEXT_BYTES)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


_owner = None


def claim(owner=None) -> None:
    """Make ``owner`` the one holder of a word table in this worker process.

    Workers outlive the stages of a job; the holder before drops its table
    (``forget``) and the memory goes back, so that stages of different
    operators don't add up. Operators without a table claim for nobody.
    """
    global _owner
    if _owner is not owner:
        if _owner is not None:
            _owner.forget()
        _owner = owner
        tidy()


def tidy() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
