"""Exact duplicates against a minimal perfect hash of historical digests.

The history's distinct digests are split into buckets.  Each bucket gets a minimal
perfect hash: keys that hash alone on a level take the level's next free slot, the
others go one level down.  A slot holds the whole 32-byte digest, the locator of
the winning row and the number of rows.  Incoming digests look their slot up and
compare all bytes; nonmembers are grouped on their own.

Texts are equal when identical after lower-casing A-Z.  Null text counts as empty.
Of equal texts the row with the largest id stays (null ids are smallest); of
repeated rows with one id, exactly one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import mix, thrifty
from tidyledger.session import stored

BUCKET_KEYS = 200_000  # digests of one bucket, on average
SPACE = 1.5  # places for a key on a level
_SLOT = np.dtype([("digest", "S32"), ("id", "<i8"), ("null_id", "?"), ("row", "<i8"), ("size", "<i8")])
_GROUP = pa.schema(
    [("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())]
)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, digest)`` of every row, SHA-256 of the normalised text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [
                hashlib.sha256(str(x).encode().lower() if x.is_valid else b"").digest()
                for x in part.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(values, pa.binary())], names=["id", "digest"]
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(thrifty(run), "id long, digest binary")


def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
    """Place of each digest on a level; digests are evenly spread, so 16 bytes do."""
    words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 4)
    return mix(words[:, 0] + words[:, 1] * np.uint64(2 * level + 1)) % np.uint64(places)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit map of each level, slot of each key) of a minimal perfect hash over distinct digests."""
    levels, slots, left, taken = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        places = int(SPACE * len(left)) + 1
        place = _place(keys[left], len(levels), places).astype(np.int64)
        single = np.bincount(place, minlength=places) == 1
        rank = np.cumsum(single) - 1
        alone = single[place]
        slots[left[alone]] = taken + rank[place[alone]]
        taken += int(single.sum())
        levels.append(single)
        left = left[~alone]
    return levels, slots


def find(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 if no level has it; a nonmember may get a member's slot."""
    slots, left, taken = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for number, single in enumerate(levels):
        place = _place(keys[left], number, len(single)).astype(np.int64)
        hit = single[place]
        slots[left[hit]] = taken + np.cumsum(single)[place[hit]] - 1
        taken += int(single.sum())
        left = left[~hit]
    return slots


def _records(group: pa.Table) -> np.ndarray:
    out = np.zeros(group.num_rows, _SLOT)
    raw = b"".join(group.column("digest").to_pylist())
    out["digest"] = np.frombuffer(raw, "S32") if raw else []
    out["null_id"] = group.column("id").is_null().to_numpy()
    out["id"] = group.column("id").fill_null(0).to_numpy()
    out["row"], out["size"] = group.column("row").to_numpy(), group.column("size").to_numpy()
    return out


def _raw(records: np.ndarray) -> np.ndarray:
    """All 32 bytes of the digests; numpy's fixed strings would drop zero bytes at the end."""
    return np.ascontiguousarray(records).view(np.uint8).reshape(len(records), _SLOT.itemsize)[:, :32]


def _index(group: pa.Table) -> pa.Table:
    records = _records(group)
    levels, slots = build(_raw(records))
    table = np.zeros(len(records), _SLOT)
    table[slots] = records
    return pa.table(
        {
            "bucket": group.column("bucket").slice(0, 1),
            "places": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "slots": pa.array([table.tobytes()], pa.binary()),
        }
    )


def _lookup(index: pa.Table, incoming: pa.Table) -> pa.Table:
    new = _records(incoming)
    if index.num_rows:
        places = index.column("places")[0].as_py()
        bits = np.unpackbits(np.frombuffer(index.column("bits")[0].as_py(), np.uint8), count=sum(places))
        levels = np.split(bits.astype(bool), np.cumsum(places)[:-1])
        slots = np.frombuffer(index.column("slots")[0].as_py(), _SLOT).copy()
        at = find(levels, _raw(new)) if len(new) else np.zeros(0, np.int64)
        member = at >= 0
        member[member] = (_raw(slots[at[member]]) == _raw(new[member])).all(1)
        old, seen = slots[at[member]], new[member]
        key = lambda x: (~x["null_id"], x["id"], x["row"])
        a, b = key(old), key(seen)
        later = (b[0] > a[0]) | (b[0] == a[0]) & ((b[1] > a[1]) | (b[1] == a[1]) & (b[2] > a[2]))
        for name in ("null_id", "id", "row"):
            old[name] = np.where(later, seen[name], old[name])
        old["size"] += seen["size"]
        slots[at[member]] = old
        records = np.concatenate((slots, new[~member]))
    else:
        records = new
    raw = _raw(records)
    return pa.table(
        [
            pa.array([x.tobytes() for x in raw], pa.binary()),
            pa.array(records["id"], mask=records["null_id"]),
            pa.array(records["row"]),
            pa.array(records["size"]),
        ],
        schema=_GROUP,
    )


def exact_duplicates(
    docs: DataFrame,
    historical: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """``(id, digest, keep_id, group_size, kept)`` for every row of ``docs``.

    ``historical`` tells which ids make up the history; null counts as incoming.  The
    result does not depend on it, only which rows are indexed and which are looked up.
    """
    rows = digests(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    rows = stored(
        rows.withColumn("old", F.coalesce(historical, F.lit(False))).select("id", "row", "old", "digest"),
        "exact-digests",
    )
    # Equal rows meet as one row for each task before the shuffle.
    order = F.struct(F.coalesce(F.col("id"), F.lit(-(2**63))).alias("id"), F.col("id").isNotNull().alias("real"), "row")
    best = F.max(F.struct(F.col("id").isNotNull().alias("real"), order["id"].alias("id"), "row"))
    grouped = rows.groupBy("digest", "old").agg(best.alias("best"), F.count("*").alias("size"))
    grouped = grouped.select(
        "digest",
        "old",
        F.when(F.col("best.real"), F.col("best.id")).alias("id"),
        F.col("best.row").alias("row"),
        "size",
    )
    grouped = stored(grouped, "exact-groups")
    buckets = grouped.count() // bucket_keys + 1
    grouped = grouped.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    index = stored(
        grouped.where("old").groupBy("bucket").applyInArrow(
            thrifty(_index), "bucket int, places array<int>, bits binary, slots binary"
        ),
        "exact-index",
    )
    incoming = grouped.where("not old").groupBy("bucket")
    found = index.groupBy("bucket").cogroup(incoming).applyInArrow(
        _lookup, "digest binary, keep_id long, keep_row long, group_size long"
    )
    found = stored(found, "exact-found")
    return rows.join(found, "digest").select(
        "id",
        "digest",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )
