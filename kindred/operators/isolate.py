"""Run a function over batches of rows so that rows it fails on are found and kept apart with their reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

REASON = "failed"


def isolated(rows: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], added: str, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with the columns ``added`` (a schema) that a function gives for each row of a batch, and ``failed``: null, or the name of what it raised.

    A batch that fails (any exception, a recursion too deep or memory that runs out too) is cut in halves, and these
    again, until a row is alone; that row comes back with its reason and nulls, all others with their results. b bad rows
    among n cost some 2 b log2(n / b) more calls. The function sees ``columns`` (all, if none are named) and must give one row
    for each that it got, in order; another number of rows counts as a failure. Rows are neither lost nor repeated, an
    empty table stays empty, and columns that are called like added ones or ``failed`` are replaced.
    """
    extra = T._parse_datatype_string(added)
    rows = rows.drop(*[f.name for f in extra.fields], REASON)
    kept = T.StructType(rows.schema.fields)
    types = to_arrow_schema(extra)
    names = columns or rows.columns

    def attempt(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str | None]]:
        """Pieces of a batch in order, with what the function gave for them or why it failed."""
        todo = [b]
        while todo:
            part = todo.pop()
            try:
                out = function(part.select(names))
                if out.num_rows != part.num_rows:
                    raise ValueError(f"{out.num_rows} rows for {part.num_rows}")
                out = pa.RecordBatch.from_arrays([out.column(f.name).cast(f.type) for f in types], schema=types)
            except (Exception, RecursionError, MemoryError) as e:
                if part.num_rows > 1:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                    continue
                yield part, None, type(e).__name__
            else:
                yield part, out, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, out, why in attempt(b) if b.num_rows else ():
                own = out.columns if out is not None else [pa.nulls(part.num_rows, f.type) for f in types]
                yield pa.RecordBatch.from_arrays([*part.columns, *own, pa.array([why] * part.num_rows, pa.string())], [*part.schema.names, *types.names, REASON])

    return rows.mapInArrow(run, T.StructType([*kept.fields, *extra.fields, T.StructField(REASON, T.StringType())]))
