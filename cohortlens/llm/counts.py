"""Count tables of a fixed size, summed over a whole corpus."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 32
MAX_SLOTS = 1 << 24


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum of the ``size`` int64 counts that ``count`` makes of each partition of ``df``.

    Tasks send only the filled slots, in CHUNKS parts that are added up side by side. The
    driver gets CHUNKS rows of together ``size`` counts, whatever the corpus holds.
    """
    if size > MAX_SLOTS:
        raise ValueError("the table would not fit the driver and the tasks")
    per = -(-size // CHUNKS)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = count(batches)
        rows = []
        for chunk in range(CHUNKS):
            own = slots[chunk * per : (chunk + 1) * per]
            filled = np.flatnonzero(own)
            if len(filled):
                rows.append((chunk, zlib.compress(np.diff(filled, prepend=0).astype("<u4").tobytes() + own[filled].astype("<i8").tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                raw = zlib.decompress(packed)
                n = len(raw) // 12
                total[np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))] += np.frombuffer(raw, "<i8", n, 4 * n)
        packed = zlib.compress(total.astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "counts"])

    parts = df.mapInArrow(share, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(per * CHUNKS, dtype=np.int64)
    for row in parts.toLocalIterator():
        out[row.chunk * per : (row.chunk + 1) * per] = np.frombuffer(zlib.decompress(row.counts), "<i8")
    return out[:size]
