"""Row-wise scans in Arrow batches: whole texts in, typed rows out, no exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def per_text(rows: DataFrame, build: Callable[[], Callable[[str], tuple]], ddl: str) -> DataFrame:
    """Apply a text function to the second column of `rows` (key, text), one output row per input row.

    `build` runs once per task and gives the function; null texts count as empty. The output holds the key first,
    then what the function returns. A task holds one Arrow batch at a time.
    """
    schema = schema_of(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = build()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*[function(t or "") for t in batch.column(1).to_pylist()], strict=True))
                columns = [pa.array(c, f.type) for c, f in zip(found, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return rows.mapInArrow(run, schema)


def per_groups(rows: DataFrame, keys: list[str], function: Callable[..., pa.RecordBatch | None], ddl: str) -> DataFrame:
    """Bring the rows of equal `keys` (longs) together and apply `function(batch, starts)` to runs of whole groups.

    `starts` holds the first row of each group of the batch. Many small groups come in one call; a task holds an
    Arrow batch and the rows of one group.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            first_key = tuple(c[0] for c in columns)
            new[0] = first_key != held_key
            starts = np.flatnonzero(new)
            if len(starts) and held:
                whole = batch.slice(0, starts[0])
                yield from _called(function, [*held, whole] if whole.num_rows else held, np.zeros(1, np.int64))
                held = []
            if len(starts) > 1:
                whole = batch.slice(starts[0], starts[-1] - starts[0])
                yield from _called(function, [whole], starts[:-1] - starts[0])
            held.append(batch.slice(starts[-1] if len(starts) else 0))
            held_key = tuple(c[-1] for c in columns)
        if held:
            yield from _called(function, held, np.zeros(1, np.int64))

    return placed.mapInArrow(run, ddl)


def _called(function: Callable, parts: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
    out = function(batch, starts)
    if out is not None and out.num_rows:
        yield out
