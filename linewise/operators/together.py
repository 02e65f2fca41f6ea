"""Two tables that meet by key in one shuffle, read as a stream: first the rows of one table with a key, then those of the other.

A grouped function starts anew for each key; here a task goes through all its keys in order, so many small works cost what their rows cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SIDE = "__side"


def in_order(first: DataFrame, then: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of both by key, those of `first` (`__side` 0) before those of `then` (1); columns that only one has are null in the other."""
    side = lambda t, n: t.select(*keys, F.lit(n).alias(SIDE), *[c for c in t.columns if c not in keys])
    rows = side(first, 0).unionByName(side(then, 1), allowMissingColumns=True)
    # dealt by a hash of the keys: a shuffle by the keys themselves is left out where both tables are dealt so, and their parts may then be merged or read apart
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, SIDE)


def met(first: DataFrame, then: DataFrame, keys: tuple[str, ...], begin: Callable[[list[tuple]], object], each: Callable[[object, tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `each` gives for what `begin` made of a key's rows of `first` and each row of `then`; both get all columns of their table, in order.

    A task holds the rows of `first` with one key, and a batch of the others.
    """
    kinds = StructType.fromDDL(schema)
    rows = in_order(first, then, keys)
    places = [[rows.columns.index(c) for c in (*keys, SIDE)]] + [[rows.columns.index(c) for c in t.columns] for t in (first, then)]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(kinds)
        at, own, state = None, [], None  # the key, its rows of `first`, and what they became
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            pick = lambda side: zip(*(values[k] for k in places[side]), strict=True)  # noqa: E731, B023
            out: list[tuple] = []
            for (*key, side), a, b in zip(pick(0), pick(1), pick(2), strict=True):
                if key != at:
                    at, own, state = key, [], None
                if side == 0:
                    own.append(a)
                    continue
                if state is None:
                    state, own = (begin(own),), []
                out += each(state[0], b)
            columns = list(zip(*out, strict=True)) or [()] * len(out_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return rows.mapInArrow(read, schema)
