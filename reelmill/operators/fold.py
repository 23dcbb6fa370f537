"""Folds over ordered groups that keep a small state and no more than a batch of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], begin: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """A row of schema for each row of rows: key and order columns, and what step(state, row) gives for it.

    Rows are dealt by key and sorted within their task, so that a group comes as a stream:
    a task holds one batch and one state, however long a group is. begin() makes the state
    of a group; step may change it. Rows of one key and order keep no order among them
    unless order names more columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*[rows.schema[c] for c in (*key, *order)], *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)
    own = [*key, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if (now := tuple(row[c] for c in key)) != at:
                    at, state = now, begin()
                made.append({c: row[c] for c in own} | step(state, row))
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)
