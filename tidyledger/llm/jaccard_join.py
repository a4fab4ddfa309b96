"""Similarity join of word-shingle sets by vertical partitioning.

The global order of n-grams is the order of their hashes, cut into fragments of
about equal size.

1. Every text's set is cut along the fragments.  A fragment's task sees all postings
   of its range, so it counts how often each n-gram occurs and how many n-grams of
   each text occur in another text.  These partial overlaps are counted separately
   and summed per text.  The sum bounds the overlap with any partner, so a text with
   less than the threshold of its own size has no link and leaves.
2. The rest order their shared n-grams rarest first.  Two similar texts share one of
   the first ``n - ceil(t * n) + 1``, so linking all texts that share such an n-gram
   to the least of them leaves every similar pair in one candidate group.
3. Within a candidate group the overlaps of pairs are counted fragment by fragment,
   summed per pair and compared with the exact threshold.  Pairs that are connected
   already are not counted again.

Texts with equal sets are one class from the start: a task sends a class once, so
copies cost nothing further.  A large candidate group is dealt out over tasks: all
members meet the group's first member, and only those not similar to it meet the
others, block by block.  No pair list is ever emitted, only links of a forest.

N-grams are compared by 48 bits of a 64-bit hash and sets by a 64-bit fingerprint;
sizes of sets come from 64 bits.  Null text counts as empty.  Texts without words
are linked with nothing; rows that repeat an id are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import blocks, components, local_forest, mix, shingle_hashes, text_bytes, thrifty, word_hashes
from tidyledger.llm.groups import GROUP, Forest, group_links, one_by_one
from tidyledger.session import stored

PERCENT = 75  # least similarity, in hundredths
WORDS = 5
FRAGMENT_BYTES = 12 << 20  # of text, for one fragment
SEND_POSTINGS = 1_000_000  # that a task gathers before it sends them
COUNT_POSTINGS = 1 << 20  # n-grams of a group that are counted at a time
_LAST = np.uint64(16)


# ---------------------------------------------------------------------------
# Sets
# ---------------------------------------------------------------------------
def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, set size of each row, distinct hashes by row in ascending order)`` for blocks of rows."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        text, _, _, words = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        owner, value = shingle_hashes(text, words, b - a, size)
        order = np.argsort(owner.astype(np.uint64) << np.uint64(48) | value >> _LAST)
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield a, np.bincount(owner[new], minlength=b - a), value[new]


def fingerprints(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit class for each set, the same for equal sets."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))))
    total = sums[ends[1:]] - sums[ends[:-1]]
    return mix(total + sizes.astype(np.uint64) * np.uint64(0xDA942042E4DD58B5)).view(np.int64)


def _facts(docs: DataFrame, size: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, classes = [], []
            for _, counts, values in shingle_sets(part.column(1), size):
                sizes.append(counts)
                classes.append(fingerprints(counts, values))
            if sizes:
                columns = [part.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(classes))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "class"])

    return docs.mapInArrow(thrifty(run), "doc_id long, n long, class long")


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


#: ``n`` stands in the first segment of a class that a task sends, and is 0 in the others.
_SEGMENT = np.dtype([("class", "<i8"), ("n", "<u4"), ("size", "<u4")])


def _packed(segments: np.ndarray) -> bytes:
    """Segments field by field, sizes in as few bytes as they need: with many fragments there are nearly as many segments as n-grams."""
    size = "<u1" if segments["size"].max(initial=0) < 256 else "<u4"
    fields = [segments["class"], segments["n"], segments["size"].astype(size)]
    return b"".join([np.dtype(size).itemsize.to_bytes(1), *(np.ascontiguousarray(x).tobytes() for x in fields)])


def _segments(column: pa.ChunkedArray) -> np.ndarray:
    found = [np.zeros(0, _SEGMENT)]
    for raw in (x.as_buffer().to_pybytes() for x in column):
        width = raw[0]
        own = np.zeros((len(raw) - 1) // (12 + width), _SEGMENT)
        own["class"] = np.frombuffer(raw, "<i8", len(own), 1)
        own["n"] = np.frombuffer(raw, "<u4", len(own), 1 + 8 * len(own))
        own["size"] = np.frombuffer(raw, f"<u{width}", len(own), 1 + 12 * len(own))
        found.append(own)
    return np.concatenate(found)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of all segments."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _fragments(docs: DataFrame, count: int, size: int) -> DataFrame:
    """``(fragment, segments, grams)``: for each task and fragment, the segments of its distinct classes."""

    def send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        classes, sizes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner = np.repeat(np.arange(len(classes)), sizes)
        fragment = ((values >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(fragment * len(classes) + owner, kind="stable")
        owner, fragment, values = owner[order], fragment[order], values[order] >> _LAST
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
        starts = np.flatnonzero(first)
        segments = np.zeros(len(starts), _SEGMENT)
        segments["class"] = classes[owner[starts]]
        sent, leading = np.unique(owner[starts], return_index=True)
        segments["n"][leading] = sizes[sent]
        segments["size"] = np.diff(np.append(starts, len(owner)))
        of = fragment[starts]
        for k in np.unique(of):
            a, b = np.searchsorted(of, [k, k + 1])
            grams = values[starts[a] : starts[b] if b < len(starts) else len(values)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([_packed(segments[a:b])]), pa.array([_six(grams)])],
                names=["fragment", "segments", "grams"],
            )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, postings = [], 0
        sent: set[int] = set()
        for part in parts:
            for _, sizes, values in shingle_sets(part.column(0), size):
                classes = fingerprints(sizes, values)
                fresh = np.zeros(len(classes), bool)
                for k in np.flatnonzero(sizes):
                    if (one := int(classes[k])) not in sent:
                        sent.add(one)
                        fresh[k] = True
                kept.append((classes[fresh], sizes[fresh], values[np.repeat(fresh, sizes)]))
                postings += len(kept[-1][2])
                if postings >= SEND_POSTINGS:
                    yield from send(kept)
                    kept, postings = [], 0
        if postings:
            yield from send(kept)

    return docs.select("text").mapInArrow(thrifty(run), "fragment int, segments binary, grams binary")


def _count_fragment(buckets: int):
    """How often each n-gram of a fragment occurs; sends those in several texts to their texts."""

    def run(group: pa.Table) -> pa.Table:
        segments = _segments(group.column("segments"))
        grams = np.concatenate([_eight(x.as_buffer()) for x in group.column("grams")])
        starts = np.cumsum(segments["size"].astype(np.int64)) - segments["size"]
        # A class comes once from each task; one of them counts.
        _, first = np.unique(segments["class"], return_index=True)
        bucket = segments["class"][first].view(np.uint64) % np.uint64(buckets)
        first = first[np.argsort(bucket, kind="stable")]
        segments, starts = segments[first], starts[first]
        grams = grams[_spread(starts, segments["size"].astype(np.int64))]
        order = np.argsort(grams)
        ranked = grams[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        runs = np.flatnonzero(new)
        times = np.repeat(np.diff(np.append(runs, len(ranked))), np.diff(np.append(runs, len(ranked))))
        often = np.empty(len(grams), np.uint32)
        often[order] = np.minimum(times, 2**32 - 1)
        shared = often > 1
        counts = np.add.reduceat(shared, np.cumsum(segments["size"].astype(np.int64)) - segments["size"], dtype=np.int64)
        segments = segments.copy()
        segments["size"] = counts
        bucket = segments["class"].view(np.uint64) % np.uint64(buckets)
        ends = np.concatenate(([0], np.cumsum(counts)))
        grams, often = grams[shared], often[shared]
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        told = (counts > 0) | (segments["n"] > 0)
        for k in np.unique(bucket[told]):
            a, b = np.searchsorted(bucket, [k, k + np.uint64(1)])
            rows.append(
                (
                    int(k),
                    _packed(segments[a:b][told[a:b]]),
                    _six(grams[ends[a] : ends[b]]),
                    often[ends[a] : ends[b]].astype("<u4").tobytes(),
                )
            )
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=_SHARED)

    return run


_SHARED = ["bucket", "segments", "grams", "often"]


def _survivors(percent: int):
    """Sums the partial overlaps of each text; keeps those that can reach the threshold."""

    def run(group: pa.Table) -> pa.Table:
        segments = _segments(group.column("segments"))
        sizes = segments["size"].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        classes, of = np.unique(segments["class"], return_inverse=True)
        sums = np.bincount(of, weights=sizes).astype(np.int64)
        n = np.zeros(len(classes), np.int64)
        np.maximum.at(n, of, segments["n"].astype(np.int64))
        need = -(-percent * n // 100)
        kept = sums >= need
        order = np.argsort(of, kind="stable")
        order = order[kept[of[order]]]
        place = _spread(starts[order], sizes[order])
        grams = np.concatenate([_eight(x.as_buffer()) for x in group.column("grams")])[place]
        often = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column("often")])[place]
        classes, sums, n, need = classes[kept], sums[kept], n[kept], need[kept]
        ends = np.concatenate(([0], np.cumsum(sums)))
        rare = np.lexsort((grams, often, np.repeat(np.arange(len(classes)), sums)))
        tokens, prefix = [], []
        for k in range(len(classes)):
            a, b = ends[k], ends[k + 1]
            # N-grams of no other text come first in the order: they use up the prefix.
            long = int(n[k] - need[k] + 1 - (n[k] - sums[k]))
            prefix.append(grams[rare[a : a + long]].astype(np.int64))
            tokens.append(_six(np.sort(grams[a:b])))
        return pa.table(
            [
                pa.array(classes),
                pa.array(n),
                pa.array(tokens, pa.binary()),
                pa.array(prefix, pa.list_(pa.int64())),
            ],
            names=["class", "n", "tokens", "prefix"],
        )

    return run


# ---------------------------------------------------------------------------
# Pairs of a candidate group
# ---------------------------------------------------------------------------
def set_links(percent: int):
    """Compares sets ``(size, shared n-grams)``, for :func:`group_links`."""

    def compare(rows: list[tuple], left: int | None) -> list[tuple[int, int]]:
        sizes, tokens = np.array([x[0] for x in rows], np.int64), [_eight(x[1]) for x in rows]
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in tokens])
        grams = np.concatenate(tokens)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        runs = np.append(np.flatnonzero(new), len(grams))
        # Fragments of the group's own order: partial overlaps are counted for each and summed.
        cuts = np.unique(np.append(np.searchsorted(runs, np.arange(0, len(grams), COUNT_POSTINGS)), len(runs) - 1))
        forest, links = Forest(len(rows)), []
        for a in range(len(rows) if left is None else left):
            others = forest.apart(a)
            if not len(others):
                continue
            overlap = np.zeros(len(rows), np.int64)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                heads = grams[runs[x:y]]
                low, high = np.searchsorted(tokens[a], [heads[0], heads[-1] + np.uint64(1)])
                at = x + np.searchsorted(heads, tokens[a][low:high])
                place = _spread(runs[at], runs[at + 1] - runs[at])
                overlap += np.bincount(owner[place], minlength=len(rows))
            union = sizes[a] + sizes - overlap
            for b in others[(100 * overlap >= percent * union)[others]].tolist():
                if forest.join(a, b):
                    links.append((a, b))
        return links

    return compare


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    size: int = WORDS,
    fragment_bytes: int = FRAGMENT_BYTES,
    group: int = GROUP,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class)`` of every row of ``docs``.

    ``component_id`` is the least id that links reach; texts of one ``class`` have equal sets.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    facts = stored(_facts(rows, size), "jaccard-facts")
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    count = total // fragment_bytes + 1
    shared = _fragments(rows, count, size).groupBy("fragment").applyInArrow(
        thrifty(_count_fragment(count)), "bucket int, segments binary, grams binary, often binary"
    )
    sets = stored(
        shared.groupBy("bucket").applyInArrow(
            thrifty(_survivors(percent)), "class long, n long, tokens binary, prefix array<long>"
        ),
        "jaccard-sets",
    )
    postings = sets.select("class", F.explode("prefix").alias("gram"))
    least = postings.groupBy("gram").agg(F.min("class").alias("least"), F.count("*").alias("k")).where("k > 1")
    near = postings.join(least, "gram").where("class <> least").select(
        F.col("class").alias("a"), F.col("least").alias("b")
    )
    groups = stored(components(local_forest(near).distinct(), "jaccard-candidates"), "jaccard-groups")
    members = sets.select(F.col("class").alias("node"), "n", "tokens")
    links = group_links(members, groups, one_by_one(set_links(percent)), "jaccard", group)
    roots = components(links, "jaccard-links")
    own = facts.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    own = own.join(roots.withColumnRenamed("node", "class"), "class", "left")
    own = stored(own.withColumn("root", F.coalesce("root", "class")), "jaccard-classes")
    least_of = own.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = own.join(least_of, "root").select("class", "component_id")
    linked = facts.where("n > 0").join(of_class, "class")
    alone = facts.where("n = 0").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "class"]
    return linked.select(*names).unionByName(alone.select(*names))
