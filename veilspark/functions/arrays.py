"""Arrays within a row: a value used twice but worked out once, and running sums and maxima in n log n; and Arrow batches cut small."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array the ``join`` (sum, maximum) of all values up to it.

    Each step joins a value with what lies a distance before it, and doubles the
    distance, so an array of n values is gone over log n times and never copied
    value by value.
    """
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    distances = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: k < steps), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(distances, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(F.get(acc, i - d), x)).otherwise(x)))


def sliced(batches: Iterable[pa.RecordBatch], column: int, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``budget`` bytes of texts in a column, and at least one row: Python objects take many times as much."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + budget, "right")))
            yield batch.slice(start, end - start)
            start = end
