"""A bitmap of fixed size over 64-bit names: may pass strangers, never drops a member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from utterlab.llm.words import U64, mix

BITS = 23


def slot(names: np.ndarray) -> np.ndarray:
    return mix(names.view(np.uint64)) >> U64(64 - BITS)


def member_filter(names: DataFrame) -> np.ndarray:
    """Flags by ``slot`` for the first column of ``names``; 1 MB per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[slot(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"]
        )

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in names.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits).astype(bool)
