"""Packing texts into token sequences by minimum bin slack.

Every text becomes ids plus an end id and is cut into whole windows and a rest.
Only the number of pieces of each length is planned: a bitset subset-sum program
picks the multiset of remaining lengths that fills a window closest to its
capacity, backtracks how often each length is used, and applies the pattern as
often as the counts allow.  The plan has no more than a few patterns for each
length, whatever the size of the corpus; pieces find their place by their rank
among the pieces of their length.

Null text counts as empty (its one id is the end id); null or repeated ids of
texts are carried along, equal pieces are interchangeable.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import blocks, text_bytes, thrifty
from tidyledger.session import stored

CAPACITY = 2048
END_ID = 1
SALT_PIECES = 50_000  # pieces of one length that one task ranks, on average
CHUNK_BYTES = 1 << 21  # texts whose words are looked up together
KNOWN_WORDS, KNOWN_BYTES = 1 << 19, 1 << 25  # beyond these a worker starts to remember words anew


class Tokenizer:
    """Ids of a byte-level vocabulary; ``special`` are added tokens, which texts are split at first."""

    def __init__(self, ranks: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = dict(special)
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        self.sizes[list(table.values())] = [len(x) for x in table]
        self._forget()

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """All ids of one text."""
        if self.split is None or not self.split.search(text):
            return self.plain(text)
        parts = [x for x in self.split.split(text) if x]
        found = [np.array([self.special[x]], np.uint32) if x in self.special else self.plain(x) for x in parts]
        return np.concatenate(found)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text; a word's ids are looked up, new words are encoded in one call.

        A single space between other characters always starts a new pre-token, so texts
        without other runs of white space around their spaces are encoded word by word.
        """
        odd = np.array([bool(self.split and self.split.search(x)) for x in texts], bool)
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.utf8_trim_whitespace(flat.dictionary)
        edge = pc.or_(pc.not_equal(bare, flat.dictionary), pc.equal(bare, "")).to_numpy(zero_copy_only=False)
        lone = np.diff(offsets) == 1
        mixed = edge[codes] if len(codes) else np.zeros(0, bool)
        odd |= np.add.reduceat(mixed, offsets[:-1]) > 0 if len(texts) else False
        odd &= ~(lone & (np.array([not x for x in texts], bool)))  # no text at all is not odd
        heads = offsets[:-1]  # the first word of a text has no space before it
        first = [np.zeros(0, np.uint32) if x else self.plain(y.split(" ", 1)[0]) for x, y in zip(odd, texts, strict=True)]
        later = np.repeat(~odd, np.diff(offsets))
        later[heads] = False
        used = np.unique(codes[later])
        place = np.zeros(len(flat.dictionary), np.int64)
        place[used] = self._places(flat.dictionary.take(pa.array(used)))
        codes = np.where(later, place[codes], -1)
        head_sizes = np.array([len(x) for x in first], np.int64)
        codes[heads] = len(self.known) + np.arange(len(heads))
        ids = np.concatenate([self.known_ids, *first])
        begins = np.concatenate((self.begins, len(self.known_ids) + np.cumsum(head_sizes) - head_sizes))
        sizes = np.concatenate((self.counts, head_sizes))
        counts = np.where(codes < 0, 0, sizes[codes])
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        taken = ids[np.arange(total) + np.repeat(begins[codes] - ends + counts, counts)]
        edges = np.concatenate(([0], ends))[offsets]
        if len(self.known) > KNOWN_WORDS or self.known.nbytes > KNOWN_BYTES:
            self._forget()
        return [
            self.ids(text) if alone else taken[a:b]
            for text, alone, a, b in zip(texts, odd.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]

    def _forget(self) -> None:
        self.known, self.known_ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of the words, each with a space before it, among the known ones; new words become known."""
        found = pc.index_in(words, value_set=self.known)
        new = words.filter(found.is_null())
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[found.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        if len(new):
            whole = pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new.cast(pa.string()))
            ids = self.plain(" " + pc.binary_join(whole, " ")[0].as_py())
            sizes = self.sizes[ids]
            length = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            begins = np.searchsorted(np.cumsum(sizes) - sizes, np.cumsum(length) - length)
            self.begins = np.concatenate((self.begins, begins + len(self.known_ids)))
            self.counts = np.concatenate((self.counts, np.diff(np.append(begins, len(ids)))))
            self.known_ids = np.concatenate((self.known_ids, ids))
            self.known = pa.concat_arrays([self.known, new])
        return at


@cache
def tokenizer(ranks: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Tokenizer:
    return Tokenizer(ranks, pattern, special)


def _chunks(part: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of at most ``limit`` bytes, or of one longer text; only they become Python strings."""
    _, offsets = text_bytes(part.column(1))
    for a, b in blocks(offsets, limit):
        docs, texts = (x.slice(a, b - a) for x in part.columns)
        yield docs.to_pylist(), texts.fill_null("").to_pylist()


def pieces(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    special: tuple[tuple[str, int], ...] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Windows of at most ``capacity`` ids of every text, with the CRC-32 of their ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(ranks, pattern, special)
        for part in parts:
            for docs, texts in _chunks(part):
                rows = []
                for doc, ids in zip(docs, words.many(texts), strict=True):
                    raw = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                    for at in range(0, len(raw), 4 * capacity):
                        window = raw[at : at + 4 * capacity]
                        rows.append((doc, at // 4, len(window) // 4, zlib.crc32(window), len(raw) // 4))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(thrifty(run), schema)


def _fill(gap: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths whose sum is as close to ``gap`` as can be, from above never."""
    reach, layers, limit = 1, [], (1 << (gap + 1)) - 1
    for length in sorted((x for x in counts if x <= gap), reverse=True):
        for _ in range(min(counts[length], gap // length)):
            wider = (reach | reach << length) & limit
            if wider == reach:
                break
            layers.append((length, reach))
            reach = wider
        if reach >> gap & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(repetitions, {length: times in one sequence})``, longest lengths first."""
    left, patterns = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = _fill(capacity - longest, {x: n for x, n in left.items() if n})
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        patterns.append((times, used))
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return patterns


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, times in a sequence, offset)."""
    slots: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, used in patterns:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            slots.setdefault(length, []).append((rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    special: tuple[tuple[str, int], ...] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; pieces lie gapless in a sequence."""
    cut = stored(pieces(docs, ranks, pattern, special, id_column, text_column, capacity), "packing-pieces")
    # At most ``capacity`` rows reach the driver.
    counts = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(counts, capacity))
    salts = sum(counts.values()) // SALT_PIECES + 16
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("place", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place") + F.col("ahead")).alias("rank")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = part.column(2).to_numpy(), part.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                rows = slots[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                place = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + place // row[:, 2]
                offset[mine] = row[:, 3] + place % row[:, 2] * one
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*part.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        thrifty(run),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
