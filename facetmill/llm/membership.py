"""A bitmap of fixed size that tells which keys are surely not in a set.

Tasks mark the bits of their keys and ship the blocks they touched; blocks are
merged in tasks and 2**BITS bits at most reach the driver and the broadcast. A key
that isn't in the set passes with a chance of the share of marked bits, so an
exact join has to follow; what is gained is that it sees few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textcore as tc

BITS = 26
_BLOCK = 1 << 16


def marked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(tc.U) & tc.U((1 << BITS) - 1)
    return (k >> tc.U(3)).astype(np.int64), (np.uint8(1) << (k & tc.U(7)).astype(np.uint8))


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of a column of longs, as bytes."""

    def mark(batches):
        bits = np.zeros((1 << BITS) >> 3, np.uint8)
        for b in batches:
            np.bitwise_or.at(bits, *marked(b.column(0).to_numpy(zero_copy_only=False)))
        blocks = [(i, x) for i, x in enumerate(bits.reshape(-1, _BLOCK)) if x.any()]
        yield _rows(blocks)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
                total[i] = total[i] | x if i in total else x
        yield _rows(list(total.items()))

    out = np.zeros((1 << BITS) >> 3, np.uint8)
    parts = tc.arrow_batches(keys, mark, "block int, bits binary").repartition(16, "block")
    for r in tc.arrow_batches(parts, merge, "block int, bits binary").collect():  # of a fixed size
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.bits), np.uint8)
    return out


def _rows(blocks: list) -> pa.RecordBatch:
    data = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for _, x in blocks]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array(data, pa.binary())], ["block", "bits"])


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bit = marked(keys)
    return bits[at] & bit > 0
