"""Membership filters of a bounded size: bit maps that are built by Spark and sent to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import mix, thrifty

MOST_BITS = 1 << 27  # 16 MB, whatever the number of members; a fuller map only lets more strangers pass
CHUNK_BITS = 1 << 20
HASHES = 3


def _places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield mix(values + np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64)) & np.uint64(bits - 1)


class Membership:
    """A Bloom filter over 64-bit numbers: a member always passes."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __contains__(self, value: int) -> bool:
        return bool(self.match(np.array([value], np.uint64))[0])

    def match(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for place in _places(values, self.bits):
            byte = self.packed[(place >> np.uint64(3)).astype(np.int64)]
            found &= (byte >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def membership(values: DataFrame, most_bits: int = MOST_BITS) -> Membership:
    """The filter of a column of longs.  Its chunks are filled by tasks; at most ``most_bits`` reach the driver."""
    count = values.count()
    bits = CHUNK_BITS
    while bits < min(most_bits, 16 * count):
        bits *= 2

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            members = part.column(0).to_numpy().view(np.uint64)
            if len(members):
                places = np.unique(np.concatenate(list(_places(members, bits)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((places // CHUNK_BITS).astype(np.int32)), pa.array(places % CHUNK_BITS)],
                    names=["chunk", "place"],
                )

    def fill(group: pa.Table) -> pa.Table:
        chunk = np.zeros(CHUNK_BITS, bool)
        chunk[group.column("place").to_numpy()] = True
        return pa.table(
            {
                "chunk": group.column("chunk").slice(0, 1),
                "packed": pa.array([np.packbits(chunk, bitorder="little").tobytes()], pa.binary()),
            }
        )

    places = values.select(F.col(values.columns[0]).cast("long")).dropna().mapInArrow(thrifty(run), "chunk int, place long")
    chunks = places.distinct().groupBy("chunk").applyInArrow(thrifty(fill), "chunk int, packed binary")
    packed = np.zeros(bits // 8, np.uint8)
    # In one job: fetched partition by partition, each of them would wait for the one before.
    for row in chunks.collect():
        at = row["chunk"] * (CHUNK_BITS // 8)
        packed[at : at + CHUNK_BITS // 8] = np.frombuffer(row["packed"], np.uint8)
    return Membership(bits, packed)
