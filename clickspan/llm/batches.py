"""Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of equal keys of sorted batches, one by one; a key may come in several stretches in a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        begin = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[begin]:
                yield rows[begin], batch.slice(begin, i - begin)
                begin = i
