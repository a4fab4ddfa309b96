"""Comparing the members of candidate groups with each other, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import thrifty
from tidyledger.session import stored

GROUP = 512  # members that one task compares with each other

#: Gets groups: the members' columns and how many of them, from the first, stand on the left
#: (None: all); returns each group's links by place, among pairs that have a left member.
Compare = Callable[[list[tuple[list[tuple], int | None]]], list[list[tuple[int, int]]]]


def one_by_one(compare: Callable[[list[tuple], int | None], list[tuple[int, int]]]) -> Compare:
    """Compares a group at a time."""
    return lambda groups: [compare(rows, left) for rows, left in groups]


class Forest:
    """Groups of places that are connected so far."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Connect two places; False if they were connected."""
        a, b = self.find(a), self.find(b)
        self.parent[b] = a
        return a != b

    def apart(self, a: int) -> np.ndarray:
        """Places that are not connected with ``a``."""
        root = self.find(a)
        return np.array([b for b in range(len(self.parent)) if self.find(b) != root], np.int64)


def _compare(rows: DataFrame, keys: list[str], columns: list[str], compare: Compare, bunch: int) -> DataFrame:
    """Links within each key; all rows of a key come one after the other, the left ones first."""
    width = len(columns) + 2

    def emit(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        lefts = [sum(x[1] for x in rows) or None for rows in groups]
        found = compare([([x[2:] for x in rows], left) for rows, left in zip(groups, lefts, strict=True)])
        for rows, links in zip(groups, found, strict=True):
            if links:
                a, b = (np.array(x) for x in zip(*links, strict=True))
                nodes = np.array([x[0] for x in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[b]), pa.array(nodes[a])], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, groups, held = None, {}, [], 0
        for part in parts:
            values = [x.to_pylist() for x in part.columns]
            for row, now in zip(zip(*values[:width], strict=True), zip(*values[width:], strict=True), strict=True):
                if now != key and group:
                    groups.append(list(group.values()))
                    group = {}
                    if held >= bunch:
                        yield from emit(groups)
                        groups, held = [], 0
                key = now
                if bunch and row[0] not in group:
                    held += len(row[2])
                group.setdefault(row[0], row)
        if group:
            yield from emit([*groups, list(group.values())])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("left"))
    return ordered.select("node", "left", *columns, *keys).mapInArrow(thrifty(run), "a long, b long")


def group_links(
    members: DataFrame, groups: DataFrame, compare: Compare, purpose: str, group: int = GROUP, bunch: int = 0
) -> DataFrame:
    """Links ``(a, b)`` among the members ``(node, columns...)`` of each candidate group ``(node, root)``.

    ``compare`` gets groups together until the texts in the first of the columns have ``bunch`` characters (0: one group).

    A group of at most ``group`` members is compared in one task.  A larger one is
    dealt out: its first member, the root, meets all others, and only those without a
    link to it meet every other member, block by block.
    """
    columns = [x for x in members.columns if x != "node"]
    chunks = F.ceil(F.count("*") / group).cast("int").alias("chunks")
    dealt = groups.join(groups.groupBy("root").agg(chunks), "root").select(
        "node", "root", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    )
    plain = stored(members.join(dealt, "node"), f"{purpose}-members").withColumn("left", F.lit(False))
    links = _compare(plain.where("chunks = 1"), ["root"], columns, compare, bunch)
    large = plain.where("chunks > 1")
    if large.isEmpty():
        return links
    everywhere = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    first = large.where("node = root").withColumn("left", F.lit(True)).withColumn("chunk", everywhere)
    others = large.where("node <> root")
    met = stored(_compare(first.unionByName(others), ["root", "chunk"], columns, compare, bunch), f"{purpose}-first")
    links = links.unionByName(met)
    rest = stored(others.join(met.select(F.col("a").alias("node")), "node", "left_anti"), f"{purpose}-rest")
    if rest.isEmpty():
        return links
    count = rest.groupBy("root").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    left = rest.join(count, "root").withColumn("block", block).withColumn("left", F.lit(True)).withColumn("chunk", everywhere)
    right = others.join(count, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = left.unionByName(right.select(left.columns))
    return links.unionByName(_compare(rows, ["root", "block", "chunk"], columns, compare, bunch))
