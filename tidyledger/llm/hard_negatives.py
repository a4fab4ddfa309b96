"""Hard negatives by bounds along a spanning tree of the anchors.

Vectors become integers ``floor(scale * x)``; a score is their inner product.  Anchors are
cut into blocks, each with a minimum spanning tree over its anchors and the zero vector;
the zero vector is the root of all of them, and its score is 0.  From a parent's score of a
candidate (or from bounds on it) follow bounds on the child's: plus or minus the length of
the edge times the candidate's norm.  Only candidates whose bounds overlap what the anchor
looks for are scored again.

* First pass, positives: rows of the anchor's label whose upper bound reaches the k-th
  largest lower bound of the block.
* Second pass, negatives: rows of other labels whose bounds overlap the window
  ``[low * positive, positive]`` of any of the anchor's positives.

Candidates are blocks of at most ``CANDIDATES`` rows; every block of anchors visits every
one of them, which is the whole search of a stated query set, in blocks.  A block of
candidates streams through a task with the anchors after it, so memory is bounded by one
block of each kind, whatever a label or a vector repeats.

Defined results: a row with a null label, a null vector, or a null or non-finite component
takes no part.  Null ids come after all others in ties and are no anchors.  Vectors of
different lengths count as filled up with zeros.  Repeated rows are rows of their own; of
rows equal to an anchor in all three columns one is the anchor itself.  Scores are exact;
those beyond a long are its end.  A positive below zero has an empty window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyledger.llm.common import thrifty
from tidyledger.session import stored

CANDIDATES = 4096  # rows of a block
ANCHORS = 64
NEAR = 4096  # so many anchors of a task are sorted together before they are cut into blocks
EXACT = 2.0**53

_BLOCK = pa.schema(
    [
        ("part", pa.int64()),
        ("number", pa.int64()),
        ("kind", pa.int32()),
        ("rows", pa.int32()),
        ("code", pa.string()),
        ("ids", pa.binary()),
        ("no_id", pa.binary()),
        ("labels", pa.binary()),
        ("vectors", pa.binary()),
        ("parents", pa.binary()),
        ("edges", pa.binary()),
    ]
)
_FIELDS = (
    "part long, number long, kind int, rows int, code string, ids binary, no_id binary, labels binary, "
    "vectors binary, parents binary, edges binary"
)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of each vector in a minimum spanning tree with the zero vector, number -1."""
    count = len(vectors)
    norms = np.sqrt((vectors * vectors).sum(1))
    parents, best = np.full(count, -1, np.int32), norms.copy()
    open_, edges = np.ones(count, bool), np.zeros(count)
    for _ in range(count):
        k = int(np.argmin(np.where(open_, best, np.inf)))
        open_[k], edges[k] = False, best[k]
        apart = vectors - vectors[k]
        far = np.sqrt((apart * apart).sum(1))
        nearer = open_ & (far < best)
        parents[nearer], best[nearer] = k, far[nearer]
    return parents, edges


class Block:
    """Rows of one block as arrays; ``vectors`` holds whole numbers."""

    def __init__(self, row: dict):
        self.number, self.rows = row["number"], row["rows"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], row["code"]).reshape(self.rows, -1).astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        if row["kind"]:
            self.parents, self.edges = np.frombuffer(row["parents"], np.int32), np.frombuffer(row["edges"], np.float64)

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in range(self.rows + 1)]
        for k, parent in enumerate(self.parents):
            below[parent].append(k)
        return below


def _packed(ids, no_id, labels, vectors, part: int, kind: int) -> dict:
    small = not vectors.size or np.abs(vectors).max() < 2**15
    code = "<i2" if small else "<f8"
    row = {
        "part": part,
        "number": 0,
        "kind": kind,
        "rows": len(ids),
        "code": code,
        "ids": ids.tobytes(),
        "no_id": no_id.tobytes(),
        "labels": labels.tobytes(),
        "vectors": vectors.astype(code).tobytes(),
        "parents": b"",
        "edges": b"",
    }
    if kind:
        parents, edges = spanning_tree(vectors)
        row |= {"parents": parents.tobytes(), "edges": edges.tobytes()}
    return row


def _read(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, ...]:
    ids = batch.column("id")
    lists = batch.column("vector")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(lengths.max(initial=0))
    vectors = np.zeros((len(lengths), width))
    vectors[np.arange(width) < lengths[:, None]] = values
    return (
        ids.fill_null(0).to_numpy(zero_copy_only=False),
        ids.is_null().to_numpy(zero_copy_only=False),
        batch.column("label").to_numpy(zero_copy_only=False),
        vectors,
        batch.column("anchor").to_numpy(zero_copy_only=False),
    )


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    width = max(x[3].shape[1] for x in parts)
    wide = [np.pad(x[3], ((0, 0), (0, width - x[3].shape[1]))) for x in parts]
    return (*(np.concatenate([x[k] for x in parts]) for k in range(3)), np.concatenate(wide))


def _blocks(rows: DataFrame, scale: float, candidates: int, anchors: int, near: int) -> DataFrame:
    """Blocks of all rows (kind 0) and of the anchors among them (kind 1), cut task by task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: list[list] = [[], []]

        def cut(kind: int, size: int, ahead: int, last: bool) -> Iterator[dict]:
            held = waiting[kind]
            while held and (last or sum(len(x[0]) for x in held) >= ahead):
                ids, no_id, labels, vectors = _joined(held)
                if kind:  # like anchors side by side: by label, then by the signs of a few components
                    signs = (vectors[:ahead, :16] >= 0) @ (1 << np.arange(min(16, vectors.shape[1]))[::-1])
                    order = np.lexsort((ids[:ahead], signs, labels[:ahead]))
                else:
                    order = np.arange(min(ahead, len(ids)))
                for first in range(0, len(order), size):
                    k = order[first : first + size]
                    yield _packed(ids[k], no_id[k], labels[k], vectors[k], part, kind)
                held[:] = [(ids[ahead:], no_id[ahead:], labels[ahead:], vectors[ahead:])] if len(ids) > ahead else []

        def out(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for row in found:
                yield pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in parts:
            if batch.num_rows:
                *row, anchor = _read(batch, scale)
                waiting[0].append(tuple(row))
                if anchor.any():
                    waiting[1].append(tuple(x[anchor] for x in row))
                yield from out(cut(0, candidates, candidates, False))
                yield from out(cut(1, anchors, near, False))
        yield from out(cut(0, candidates, candidates, True))
        yield from out(cut(1, anchors, near, True))

    made = rows.mapInArrow(thrifty(run), _FIELDS)
    return stored(made.withColumn("number", F.monotonically_increasing_id()), "negatives-blocks")


def exact_scores(anchor: np.ndarray, vectors: np.ndarray, norm: float, norms: np.ndarray) -> np.ndarray:
    """Inner products as long; whole numbers in doubles are exact while the norms' product is below 2**53."""
    width = min(len(anchor), vectors.shape[1])
    if norm * norms.max(initial=0) < EXACT:
        return (vectors[:, :width] @ anchor[:width]).astype(np.int64)
    whole = [int(x) for x in anchor[:width]]
    found = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in vectors[:, :width]]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in found], np.int64)


def tree_scores(
    anchors: Block, block: Block, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates scored again, their scores), parents before children.

    ``wanted`` gets an anchor and the bounds of all candidates' scores, and tells which
    candidates to score.
    """
    below = anchors.children()
    zero = np.zeros(block.rows)
    stack = [(k, zero, zero) for k in below[-1]]
    while stack:
        k, low, high = stack.pop()
        reach = anchors.edges[k] * block.norms * (1 + 1e-9) + 1  # the one covers rounding
        low, high = low - reach, high + reach
        again = wanted(k, low, high)
        scores = exact_scores(anchors.vectors[k], block.vectors[again], anchors.norms[k], block.norms[again])
        low[again] = high[again] = scores
        stack += [(x, low, high) for x in below[k]]
        yield k, again, scores


def _first(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the first ``count`` by falling score, then rising id, null ids last."""
    some = np.arange(len(scores))
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], no_id[some], ~scores[some]))][:count]  # ~ turns the order and cannot overflow


def _visits(blocks: DataFrame, anchors: DataFrame, step: Callable, fields: str, schema: pa.Schema) -> DataFrame:
    """Every block of anchors meets every block of candidates: the latter first, then the anchors after it."""
    tables = blocks.agg(F.max("part").alias("part"), F.max("place").alias("place")).first()
    places = (tables["place"] if tables["place"] is not None else -1) + 1
    keys = ((tables["part"] if tables["part"] is not None else -1) + 1) * places
    spark = blocks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.sequence(F.lit(0), F.lit(max(keys - 1, 0))).cast("array<long>")
    left = blocks.select((F.col("part") * places + F.col("place")).alias("key"), *anchors.drop("place").columns)
    right = anchors.drop("place").select(F.explode(numbers).alias("key"), "*")
    rows = left.unionByName(right).repartition(tasks, "key").sortWithinPartitions("key", "kind", "number")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in parts:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    key, block = row["key"], Block(row)
                elif row["key"] == key:
                    found = step(Block(row), block, row)
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema)

    return rows.mapInArrow(thrifty(run), fields)


def _positives(size: int) -> Callable:
    def step(anchors: Block, block: Block, row: dict) -> list[dict]:
        same: dict[int, np.ndarray] = {}

        def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            label = int(anchors.labels[k])
            if label not in same:
                same[label] = np.flatnonzero(block.labels == label)
            mine = same[label]
            if len(mine) <= size + 1:
                return mine
            bar = np.partition(low[mine], len(mine) - size - 1)[len(mine) - size - 1]
            return mine[high[mine] >= bar]

        out = []
        for k, again, scores in tree_scores(anchors, block, wanted):
            first = _first(scores, block.no_id[again], block.ids[again], size + 1)
            for x, score in zip(again[first].tolist(), scores[first].tolist(), strict=True):
                width = min(anchors.vectors.shape[1], block.vectors.shape[1])
                equal = (
                    not block.no_id[x]
                    and block.ids[x] == anchors.ids[k]
                    and np.array_equal(block.vectors[x, :width], anchors.vectors[k, :width])
                    and not block.vectors[x, width:].any()
                    and not anchors.vectors[k, width:].any()
                )
                out.append(
                    {
                        "number": anchors.number,
                        "place": k,
                        "score": score,
                        "id": None if block.no_id[x] else int(block.ids[x]),
                        "equal": bool(equal),
                    }
                )
        return out

    return step


def _negatives(size: int, low_share: int, high_share: int) -> Callable:
    def inside(score: np.ndarray, positive: int) -> np.ndarray:
        if abs(positive) < 2**53:
            near = np.clip(score, -(2**53), 2**53)  # beyond these it is out of the window anyway
            return (low_share * positive <= 100 * near) & (100 * near <= high_share * positive)
        return np.array([low_share * positive <= 100 * int(x) <= high_share * positive for x in score], bool)

    def step(anchors: Block, block: Block, row: dict) -> list[dict]:
        windows: list[list] = [[] for _ in range(anchors.rows)]
        for x in row["windows"] or ():
            if low_share * x["score"] <= high_share * x["score"]:
                windows[x["place"]].append((x["rank"], x["id"], x["score"]))

        def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if not windows[k]:
                return np.zeros(0, np.int64)
            scores = [x[2] for x in windows[k]]
            least, most = min(scores) * low_share / 100, max(scores) * high_share / 100
            slack = abs(most) * 1e-12 + 1
            return np.flatnonzero((block.labels != anchors.labels[k]) & (high >= least - slack) & (low <= most + slack))

        out = []
        for k, again, scores in tree_scores(anchors, block, wanted):
            for rank, positive, score in windows[k]:
                fit = np.flatnonzero(inside(scores, score))
                some = again[fit]
                for x in _first(scores[fit], block.no_id[some], block.ids[some], size).tolist():
                    out.append(
                        {
                            "number": anchors.number,
                            "place": k,
                            "positive_rank": rank,
                            "anchor_id": int(anchors.ids[k]),
                            "positive_id": positive,
                            "positive_score": score,
                            "negative_id": None if block.no_id[some[x]] else int(block.ids[some[x]]),
                            "negative_score": int(scores[fit[x]]),
                        }
                    )
        return out

    return step


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    label: str | Column = "label",
    vector_column: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    candidates: int = CANDIDATES,
    anchors: int = ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its first ``positives`` other rows of its label; for each of
    them the first ``negatives`` rows of other labels with ``window[0] * positive_score <=
    100 * negative_score <= window[1] * positive_score`` are returned.  ``is_anchor`` is a
    condition on the columns of ``rows``; null means no.
    """
    label = F.col(label) if isinstance(label, str) else label
    whole = rows.select(
        F.col(id_column).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col(id_column).isNotNull()).alias("anchor"),
    )
    infinite = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    whole = whole.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    made = _blocks(whole, scale, candidates, anchors, max(NEAR, anchors))
    # Candidate blocks are numbered within their task.
    by_task = Window.partitionBy("part").orderBy("number")
    order = made.where("kind = 0").select("number", (F.row_number().over(by_task) - 1).cast("long").alias("place"))
    blocks = made.where("kind = 0").join(order, "number")
    queries = made.where("kind = 1")

    found = _visits(
        blocks.withColumn("windows", F.lit(None).cast(_WINDOWS)),
        queries.withColumn("windows", F.lit(None).cast(_WINDOWS)),
        _positives(positives),
        "number long, place int, score long, id long, equal boolean",
        _POSITIVE,
    )
    key = Window.partitionBy("number", "place")
    ranked = key.orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("equal").desc())
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives + 1)
    own = F.min(F.when(F.col("equal"), F.col("rank"))).over(key)
    found = found.withColumn("own", F.coalesce(own, F.lit(positives + 2))).where("rank <> own")
    found = found.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("own")).cast("int"))
    found = stored(found.where(F.col("rank") <= positives), "negatives-positives")

    windows = found.groupBy("number").agg(F.collect_list(F.struct("place", "rank", "id", "score")).alias("windows"))
    result = _visits(
        blocks.withColumn("windows", F.lit(None).cast(_WINDOWS)),
        queries.join(windows, "number", "left").withColumn("windows", F.col("windows").cast(_WINDOWS)),
        _negatives(negatives, *window),
        "number long, place int, positive_rank int, anchor_id long, positive_id long, positive_score long, "
        "negative_id long, negative_score long",
        _NEGATIVE,
    )
    by_score = Window.partitionBy("number", "place", "positive_rank").orderBy(
        F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()
    )
    result = result.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_WINDOWS = "array<struct<place:int,rank:int,id:long,score:long>>"
_POSITIVE = pa.schema(
    [("number", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("equal", pa.bool_())]
)
_NEGATIVE = pa.schema(
    [
        ("number", pa.int64()),
        ("place", pa.int32()),
        ("positive_rank", pa.int32()),
        ("anchor_id", pa.int64()),
        ("positive_id", pa.int64()),
        ("positive_score", pa.int64()),
        ("negative_id", pa.int64()),
        ("negative_score", pa.int64()),
    ]
)
