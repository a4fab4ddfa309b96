"""Shared pieces of the text operators: tables, word hashes in blocks, connected groups."""

from __future__ import annotations

import ctypes
import gc
import inspect
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.session import drop_folder, stored

BLOCK_BYTES = 1 << 19  # texts are hashed in blocks of about this size
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"

_RADIX = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, purpose: str, row_group: int | None = None) -> DataFrame:
    """:func:`stored`, and the shuffle files that led to the table may go.

    Spark deletes the files of a shuffle once the driver has collected the plan as
    garbage, which a driver with little work may put off; so it is asked to.
    """
    result = stored(df, purpose, row_group)
    del df
    gc.collect()
    result.sparkSession._jvm.System.gc()
    return result


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote, once all that comes of it is written."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        drop_folder(table.sparkSession, folder)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give freed memory back to the system: an idle Python worker shares the executor's with others."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def thrifty(run: Callable) -> Callable:
    """A function for ``mapInArrow`` or ``applyInArrow`` that gives its memory back when it ends."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def over_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(parts)
            release()

        return over_parts

    @wraps(run)
    def over_group(group: pa.Table) -> pa.Table:
        result = run(group)
        release()
        return result

    return over_group


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one longer text alone."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, count)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        for name, base in (("up", _RADIX), ("down", _RADIX_INVERSE)):
            powers = np.full(max(size, BLOCK_BYTES + 1024), base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers)
    return _POWERS["up"], _POWERS["down"]


def _hash_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    edge[0] = edge[-1] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, hash) of every word of the texts, lower-cased in A-Z.

    Words are runs of bytes other than the six separators.  A text longer than a
    block is hashed in pieces cut at a separator, so memory follows the words.
    """
    pieces, first = [], 0
    while first < len(data):
        last = min(first + 2 * BLOCK_BYTES, len(data))
        while last < len(data):
            gaps = np.flatnonzero(_SPACE[data[first:last]])
            if len(gaps):
                last = first + int(gaps[-1]) + 1
                break
            last = min(last + 2 * BLOCK_BYTES, len(data))
        inside = offsets[(offsets >= first) & (offsets <= last)] - first
        starts, ends, value = _hash_block(data[first:last], inside)
        pieces.append((starts + first, ends + first, value))
        first = last
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    starts, ends, value = (np.concatenate(x) for x in zip(*pieces, strict=True))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, value


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(text: np.ndarray, words: np.ndarray, count: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words; a shorter text is one run."""
    lengths = np.bincount(text, minlength=count)
    if len(words) >= size:
        whole = text[: len(words) - size + 1] == text[size - 1 :]
        value = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            value += words[k : k + len(value)] * _SHINGLE[k]
        owner, value = text[: len(whole)][whole], mix(value[whole])
    else:
        owner, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(words)) - first[text]
        part = words * _SHINGLE[np.minimum(place, 63)] + _SHINGLE[63]
        ends = np.concatenate(([np.uint64(0)], np.cumsum(part)))
        alone = mix(ends[first[short] + lengths[short]] - ends[first[short]])
        owner, value = np.concatenate((owner, short)), np.concatenate((value, alone))
    return owner, value


def local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges ``(a, b)`` as a forest of stars around the least node.

    Only shrinks the input: a partition keeps its groups but at most one edge for a node.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        if nodes:
            roots = [find(x) for x in nodes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"]
            )

    return edges.select("a", "b").mapInArrow(thrifty(run), "a long, b long")


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; root is the group's least node.

    Every round each node takes the least node next to it and the links are
    contracted, so the graph shrinks by half at least.  Nothing reaches the driver
    but whether links are left; every round is a table in the shared folder.
    """
    links = stored(local_forest(edges.where("a <> b")), f"{purpose}-links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        least = stored(least.select("node", F.least("node", "b").alias("root")), f"{purpose}-round")
        rounds.append(least)
        left = least.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = least.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = stored(
            local_forest(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()),
            f"{purpose}-links",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[0]
    for least in rounds[1:]:
        step = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
        result = result.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")
        )
    return result
