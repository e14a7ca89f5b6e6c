"""Rows of whole numbers on their way into state: packed by key, so that Python and the state store see a key of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task gathers before it packs them, at most one batch more.
GATHERED = 500_000
#: Type of a column of packed rows.
PACKED = "packed binary"


def pack(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def unpack(cells: Iterable[bytes], width: int) -> np.ndarray:
    """The rows of several cells, one below the other."""
    return np.frombuffer(b"".join(bytes(c) for c in cells), np.int64).reshape(-1, width)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    """A batch of columns of whole numbers without nulls as rows."""
    return np.column_stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns])


def by_key(read: Callable[[pa.RecordBatch], np.ndarray], key_of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: (key long, packed binary), the rows that `read` finds in batches, one cell for each key of what is gathered; rows of a key stay in order."""

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        keys = key_of(rows)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], np.ascontiguousarray(rows[order], np.int64)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts, len(keys)).astype(np.int32) * np.int32(rows.shape[1] * 8)
        cells = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int64()), cells], names=["key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows = read(batch)
            held.append(rows)
            n += len(rows)
            if n >= GATHERED:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    return run
