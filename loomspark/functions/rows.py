"""Arrow functions of single values that hold few of them at a time, however large a batch is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many values of a batch are Python objects at once, with their results; the batch itself is bytes.
AT_ONCE = 64


def by_row(one: Callable, kind: T.DataType, arrow: pa.DataType) -> Callable:
    """A column function that gives ``one`` of each value, null for null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                yield pa.array([None if x is None else one(x) for x in batch.slice(i, AT_ONCE).to_pylist()], arrow)

    return run
