"""Rows of many small files in few Arrow batches: a batch for a file costs more than the file's rows do."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch, and bytes of its texts and contents above which it is closed before.
ROWS, BYTES = 4_096, 16 << 20


def pairs(batches: Iterable[pa.RecordBatch], first: str, second: str) -> Iterator[tuple]:
    """The values of two columns, row by row."""
    for batch in batches:
        for a, b in zip(batch.column(first), batch.column(second), strict=True):
            yield a.as_py(), b.as_py()


def schema_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def weight(value: object) -> int:
    return sum(map(weight, value)) if isinstance(value, list) else len(value) if isinstance(value, str | bytes) else 8


def together(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, none of which holds much more than one row beyond BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(weight, row))
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
