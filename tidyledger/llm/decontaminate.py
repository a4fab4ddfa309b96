"""Finding benchmark items in texts.

Texts are looked at in windows of the size of each item.  A window can only be similar
to an item if enough of its five-word shingles stand in items of that size, which a
membership filter of bounded size tells without losing any.  Those windows get a
64-bit SimHash.  Sixteen blocks of four bits index the fingerprints: every window
within a Hamming distance of 15 agrees with the item in a block, so an equal block and
size make a candidate.  Candidates are verified exactly: shingles weigh as often as
they occur, and the smaller weights over the larger ones must reach the threshold.

A text shorter than an item is one window.  An item with fewer than five words is one
shingle of all its words: a text holds it where the same words stand in a row.  Null texts
and null items have no words.  Rows that
repeat an item or a text give equal matches, which are reported once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import blocks, mix, shingle_hashes, text_bytes, thrifty, word_hashes
from tidyledger.llm.filters import Membership, membership
from tidyledger.session import stored

WORDS = 5
PERCENT = 75
BLOCKS, BLOCK_BITS = 16, 4

Runs = Callable[[int], tuple[np.ndarray, np.ndarray]]


def _sized(shingles: np.ndarray, size: int) -> np.ndarray:
    """A shingle of an item of ``size`` words."""
    return mix(shingles + np.uint64(size * 0xE7037ED1A0B428DB % 2**64))


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of a multiset of hashes, as a signed number."""
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles), bitorder="little").view("<i8")[0])


def _shingled(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Runs]]:
    """``(first row, words of each row, shingles in text order, where each row's start, runs)`` for blocks of rows.

    ``runs(n)`` gives ``(row of the block, hash)`` of the runs of ``n`` words, in text order.
    """
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        text, _, _, value = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sizes = np.bincount(text, minlength=b - a)

        def runs(n: int, text=text, value=value, sizes=sizes) -> tuple[np.ndarray, np.ndarray]:
            owner, hashes = shingle_hashes(text, value, len(sizes), n)
            whole = sizes[owner] >= n
            return owner[whole], hashes[whole]

        owner, shingles = runs(words)
        ends = np.searchsorted(owner, np.arange(b - a + 1))
        yield a, sizes, shingles, ends, runs


def read_items(items: DataFrame, id_column: str, text_column: str, words: int = WORDS) -> DataFrame:
    """``(item_id, item, size, print, shingles)`` of items with a word; ``item`` numbers the row."""
    kind = dict(items.dtypes)[id_column]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for a, sizes, shingles, ends, runs in _shingled(part.column(2), words):
                found = {k: np.sort(shingles[ends[k] : ends[k + 1]]) for k in np.flatnonzero(np.diff(ends)).tolist()}
                for size in np.unique(sizes[(sizes > 0) & (sizes < words)]).tolist():
                    owner, hashes = runs(size)
                    found |= {int(owner[x]): hashes[x : x + 1] for x in np.flatnonzero(sizes[owner] == size)}
                for k, own in sorted(found.items()):
                    rows.append((a + k, int(sizes[k]), simhash(own), own.tobytes()))
            if rows:
                at, size, prints, raw = zip(*rows, strict=True)
                columns = [part.column(x).take(pa.array(at)) for x in (0, 1)]
                arrays = [pa.array(size, pa.int32()), pa.array(prints, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], names=["item_id", "item", "size", "print", "shingles"])

    rows = items.select(
        F.col(id_column).alias("item_id"),
        F.xxhash64(id_column, text_column).alias("item"),
        F.col(text_column).alias("text"),
    )
    return rows.mapInArrow(thrifty(run), f"item_id {kind}, item long, size int, print long, shingles binary")


def _windows(rows: DataFrame, known: Membership, sizes: list[int], words: int, percent: int) -> DataFrame:
    """``(key, doc_id, size, start, print, shingles)`` of the windows with enough known shingles."""
    needs = [(size, -(-percent * (size - words + 1) // 100)) for size in sizes if size >= words]
    short = [size for size in sizes if size < words]
    fewest = min((need for _, need in needs), default=0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for a, _, shingles, ends, runs in _shingled(part.column(1), words):
                for size in short:
                    owner, hashes = runs(size)
                    start = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    seen = set()
                    for x in np.flatnonzero(known.match(_sized(hashes, size))).tolist():
                        if (one := (int(owner[x]), int(hashes[x]))) not in seen:  # the first place in a text is enough
                            seen.add(one)
                            window = hashes[x : x + 1]
                            found.append((a + one[0], size, int(start[x]), simhash(window), window.tobytes()))
                if not needs:
                    continue
                hits = np.flatnonzero(known.match(shingles))
                of = np.searchsorted(ends, hits, "right") - 1
                for k in np.flatnonzero(np.bincount(of, minlength=len(ends)) >= max(fewest, 1)).tolist():
                    own = shingles[ends[k] : ends[k + 1]]
                    mine = hits[of == k] - ends[k]
                    for size, need in needs:
                        place = mine[known.match(_sized(own[mine], size))]
                        if len(place) < need:
                            continue
                        wide = size - words + 1
                        before = np.zeros(len(own) + 1, np.int64)
                        before[place + 1] = 1
                        before = np.cumsum(before)
                        starts = np.arange(max(1, len(own) - wide + 1))
                        ends_at = np.minimum(starts + wide, len(own))
                        for s in np.flatnonzero(before[ends_at] - before[starts] >= need).tolist():
                            window = np.sort(own[s : s + wide])
                            found.append((a + k, size, s, simhash(window), window.tobytes()))
            if found:
                at, size, start, prints, raw = zip(*found, strict=True)
                arrays = [
                    part.column(0).take(pa.array(at)),
                    part.column(2).take(pa.array(at)),
                    pa.array(size, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(prints, pa.int64()),
                    pa.array(raw, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "size", "start", "print", "shingles"])

    schema = f"key long, doc_id {dict(rows.dtypes)['doc_id']}, size int, start int, print long, shingles binary"
    return rows.select("key", "text", "doc_id").mapInArrow(thrifty(run), schema)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two multisets, given as sorted arrays."""
    values, of = np.unique(np.concatenate((a, b)), return_inverse=True)
    x = np.bincount(of[: len(a)], minlength=len(values))
    y = np.bincount(of[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [
                weighted_similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                for a, b in zip(part.column(3), part.column(4), strict=True)
            ]
            similar = pa.array(values, pa.float64())
            good = pa.array([100 * x >= percent - 1e-9 for x in values], pa.bool_())
            columns = [*part.columns[:3], similar]
            batch = pa.RecordBatch.from_arrays(columns, names=["key", "item", "start", "similarity"])
            yield batch.filter(good)

    return pairs.select("key", "item", "start", "shingles", "item_shingles").mapInArrow(
        thrifty(run), "key long, item long, start int, similarity double"
    )


def _block_values() -> Column:
    bits = (1 << BLOCK_BITS) - 1
    return F.explode(
        F.array(
            *[
                F.shiftrightunsigned("print", BLOCK_BITS * k).bitwiseAND(F.lit(bits)) + (k << BLOCK_BITS)
                for k in range(BLOCKS)
            ]
        )
    )


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``(doc_id, item_id, start_word, similarity, key)``: the best window of each text for each item it holds.

    ``key`` is ``xxhash64(id, text)`` of the row.
    """
    read = stored(read_items(items, item_id_column, item_text_column, words), "items-read")
    sizes = sorted(row["size"] for row in read.select("size").distinct().collect())

    def members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for size, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                both = np.concatenate((own, _sized(own, size)))
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], names=["value"])

    known = membership(read.select("size", "shingles").mapInArrow(thrifty(members), "value long"))
    rows = docs.select(
        F.xxhash64(id_column, text_column).alias("key"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")
    )
    windows = stored(_windows(rows, known, sizes, words, percent), "items-windows")
    left = windows.select("key", "size", "start", _block_values().alias("block"))
    right = read.select("item", "size", _block_values().alias("block"))
    pairs = left.join(right, ["size", "block"]).select("key", "size", "start", "item").distinct()
    pairs = pairs.join(windows.drop("doc_id").dropDuplicates(["key", "size", "start"]), ["key", "size", "start"])
    texts = read.dropDuplicates(["item"]).select("item", F.col("shingles").alias("item_shingles"))
    good = _verified(pairs.join(texts, "item"), percent)
    best = good.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"))
    ids = windows.select("key", "doc_id").distinct()
    names = read.select("item", "item_id").distinct()
    return best.join(ids, "key").join(names, "item").select(
        "doc_id",
        "item_id",
        (-F.col("best.at")).cast("long").alias("start_word"),
        F.col("best.similarity").alias("similarity"),
        "key",
    )
