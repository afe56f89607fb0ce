"""Small helpers of the operators: stored steps, broadcasts of checked size, row numbers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.scratch import materialize

# Rows of one id column that may be sent to every task (a few MB).
BROADCAST_ROWS = 1_000_000

# Elements that are summed from the last sum that is kept.
_RUN = 128

# Bytes of text a task works on at a time.
SLAB_BYTES = 4_000_000

stored = materialize


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose tables nothing refers to any more.

    It does so when the driver's JVM collects garbage, which may else be a long time
    after a large step was stored.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def where_id_in(df: DataFrame, column: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` is (not) among ``ids``, a stored one-column table.

    The ids are broadcast only if they are counted to be few; more are joined by a
    shuffle. Either way the result is the same.
    """
    few = ids.count() <= BROADCAST_ROWS
    named = ids.toDF(column)
    return df.join(F.broadcast(named) if few else named, column, "left_semi" if keep else "left_anti")


# What this Python worker keeps from one task to the next: owner -> (key, value).
_held: dict[object, tuple[object, object]] = {}
# Whose task this worker served last.
_served: list[object] = [None]


def held(owner: object, key: object, make: Callable[[], object]) -> object:
    """``make()``, kept by this Python worker for later tasks with the same owner and key.

    A worker serves one stage after the other and keeps for one owner at a time only, so
    the next stage does not pay for what the last one remembered.
    """
    if owner not in _held or _held[owner][0] is not key:
        _held.pop(owner, None)
        let_go(but=owner)
        _held[owner] = key, make()
        hand_back()
    return _held[owner][1]


def let_go(but: object = None) -> None:
    """Free what this Python worker keeps for other owners, and hand back what it used for them."""
    others = [owner for owner in _held if owner != but]
    before, _served[0] = _served[0], but
    if not others and before == but:
        return
    for owner in others:
        del _held[owner]
    hand_back()


def hand_back() -> None:
    """Give memory that is free, but kept by this process for later, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
    if trim:
        trim(0)


def by_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, owner: object = None
) -> DataFrame:
    """``function`` over every Arrow batch of ``df``; ``owner`` tells whose state its tasks keep, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(but=owner)
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def slabs(texts: pa.Array, size: int = SLAB_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes of text each; null texts become empty."""
    texts = pc.fill_null(texts, "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def crc32_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, not again for every element that a lambda sees."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Sums up to and with each element of a bound array: whole runs first, then within the element's run."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    runs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / _RUN).cast("int"), F.lit(0)))
    of_runs = F.transform(runs, lambda r: total(F.slice(lengths, r * _RUN + 1, F.lit(_RUN))))
    sums = F.aggregate(of_runs, F.array(F.lit(0)), lambda so_far, x: F.array_append(so_far, F.element_at(so_far, -1) + x))
    return bound(
        sums,
        lambda before: F.transform(
            lengths,
            lambda _, k: F.get(before, F.floor(k / _RUN).cast("int")) + total(F.slice(lengths, k - k % _RUN + 1, k % _RUN + 1)),
        ),
    )
