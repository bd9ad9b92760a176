"""A Bloom filter of bounded size over 64-bit keys, built on the executors.

It only spares a shuffle the rows that can't matter: whatever passes it is
joined exactly afterwards, so a full filter costs time, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix

#: Bits for each key, and the least and most bits in all: 128 kB to 32 MB.
BITS_PER_KEY = 16
LOG_BITS = (20, 28)
_LOG_BLOCK = 16


def log_size(keys: int) -> int:
    return min(max((BITS_PER_KEY * keys).bit_length(), LOG_BITS[0]), LOG_BITS[1])


def positions(keys: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each key."""
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    mask = np.uint64((1 << log_bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _bits(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One packed block of bits for each block that a task's keys touch."""
        have = np.zeros(1 << log_bits >> 3, np.uint8)
        for batch in batches:
            for at in positions(batch.column(0).to_numpy(zero_copy_only=False), log_bits):
                np.bitwise_or.at(have, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        blocks = have.reshape(-1, 1 << _LOG_BLOCK >> 3)
        for k in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], ["block", "bits"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal number, united; a task holds at most the whole filter."""
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(bits, np.uint8)
            have[k] = got | have[k] if k in have else got
    for k, bits in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])


class Bloom:
    def __init__(self, rows: list[tuple[int, bytes]], log_bits: int):
        self._log_bits, self._bits = log_bits, np.zeros(1 << log_bits >> 3, np.uint8)
        step = 1 << _LOG_BLOCK >> 3
        for k, bits in rows:
            self._bits[k * step : (k + 1) * step] = np.frombuffer(bits, np.uint8)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        a, b = positions(keys, self._log_bits)
        hit = lambda at: (self._bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return (hit(a) & hit(b)).astype(bool)


def bloom(keys: DataFrame):
    """A broadcast Bloom filter of a one-column DataFrame of longs, which is read twice; repeated keys only make it larger."""
    schema = "block int, bits binary"
    key = keys.select(F.col(keys.columns[0]).cast("long")).na.drop()
    log_bits = log_size(key.count())
    whole = key.mapInArrow(_bits(log_bits), schema).repartition("block").mapInArrow(_either, schema)
    rows = [(r.block, bytes(r.bits)) for r in whole.collect()]  # at most 2**28 bits
    return keys.sparkSession.sparkContext.broadcast(Bloom(rows, log_bits))
