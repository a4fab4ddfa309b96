"""A trie of all conversations' prefixes: a Z-fast trie filled in batches, then expanded.

Nodes of the trie are prefixes of turn sequences.  A prefix is known by its depth and a
128-bit polynomial hash, whose parts add up, so a conversation of any length is hashed in
blocks of ``BLOCK`` turns.  The compacted trie is a table: a node's skip interval ``(a, b]``
runs from its parent's depth to its own, and its handle is the prefix whose depth is the
2-fattest number of the interval (the one with most trailing zero bits).

Distinct sequences are inserted in batches.  Each finds its exit node by fat binary
search: the interval ``(lo, hi]`` is halved at its 2-fattest number; if the prefix of that
depth is a handle, the search goes on below that node, else above.  So a sequence of L turns
asks the table log2(L) times, by a join for a whole batch.  The place within the exit edge
comes from comparing hashes with a conversation of that edge.  A batch then adds all its ends,
its exits inside edges and the points where its own new tails part, and edges that were split get
new intervals and handles; nothing else is touched.

Members, leaves and saved tokens are summed over hashes with partial sums, so a first turn
that all conversations share is one row for each task.  Edges are expanded last.

Defined results: conversations without an id take no part; equal sequences are members of the
same nodes; an empty table has no node.  Sequences are told apart by 128 bits.  A lost
executor repeats its tasks from the written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyledger.llm.common import thrifty
from tidyledger.session import stored

BLOCK = 1024
BATCHES = (1, 4, 16)  # a sequence belongs to the first batch above its hash modulo 16
STEPS = 3  # of a search in one plan

_RADIX = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)  # odd
_PATH = "conv long, block long, p array<long>, q array<long>, s array<long>"
_KEY = ["depth", "p", "q"]


def turn_hashes(role: str = "role", text: str = "text") -> dict[str, Column]:
    """Two independent 64-bit hashes of a turn and its code points; null counts as empty."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return {
        "t1": F.xxhash64(role, text),
        "t2": F.xxhash64(F.lit("second"), text, role),
        "chars": F.length(text).cast("long"),
    }


# -- hashes of all prefixes, in blocks ---------------------------------------------------


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def _hash_blocks(size: int):
    powers = []
    for radix in _RADIX:
        up = np.full(size + 1, radix, np.uint64)
        up[0] = 1
        powers.append(np.cumprod(up))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            block = part.column("block").to_numpy()
            counts = part.column("t1").value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            place = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts)
            columns = []
            for name, radix, up in (("t1", _RADIX[0], powers[0]), ("t2", _RADIX[1], powers[1]), ("chars", None, None)):
                values = part.column(name).flatten().to_numpy().astype(np.int64).view(np.uint64)
                if up is not None:
                    far = {int(k): pow(radix, int(k) * size, 1 << 64) for k in np.unique(block)}
                    lift = np.array([far[int(k)] for k in block], np.uint64)
                    values = values * up[place + 1] * np.repeat(lift, counts)
                sums = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
                inner = np.arange(len(values) + len(counts)) - np.repeat(np.arange(len(counts)), counts + 1)
                base = np.repeat(sums[ends - counts], counts + 1)  # every list begins with 0
                columns.append(_lists((sums[inner] - base).view(np.int64), counts + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("block"), *columns], names=["conv", "block", "p", "q", "s"]
            )

    return run


def _add_carry(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        counts = part.column("p").value_lengths().to_numpy().astype(np.int64)
        columns = []
        for name in "pqs":
            low, high = (part.column(f"{name}_{x}").to_numpy().astype(np.uint64) for x in ("low", "high"))
            carry = np.repeat(low + (high << np.uint64(32)), counts)
            values = part.column(name).flatten().to_numpy().astype(np.int64).view(np.uint64) + carry
            columns.append(_lists(values.view(np.int64), counts))
        yield pa.RecordBatch.from_arrays(
            [part.column("conv"), part.column("block"), *columns], names=["conv", "block", "p", "q", "s"]
        )


def prefix_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv, block, p, q, s)``: hashes and code points of the prefixes of depth ``block * size`` and on.

    ``turns`` has ``(conv, depth, t1, t2, chars)`` with depths 1, 2, ... of each conversation.
    """
    number = F.floor((F.col("depth") - 1) / block).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("depth", "t1", "t2", "chars")))
    raw = turns.groupBy("conv", number.alias("block")).agg(rows.alias("rows"))
    raw = raw.select("conv", "block", *(F.col(f"rows.{x}").alias(x) for x in ("t1", "t2", "chars")))
    local = stored(raw.mapInArrow(thrifty(_hash_blocks(block)), _PATH), "trie-local")
    # What the blocks before add up to, by halves: a sum of longs would overflow.
    last = {x: F.element_at(x, -1) for x in "pqs"}
    halves = {f"{x}_low": last[x].bitwiseAND(F.lit(0xFFFFFFFF)) for x in "pqs"}
    halves |= {f"{x}_high": F.shiftrightunsigned(last[x], 32) for x in "pqs"}
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = local.select("conv", "block", *(v.alias(k) for k, v in halves.items()))
    carries = carries.select("conv", "block", *(F.sum(x).over(before).alias(x) for x in halves)).where("block > 0")
    later = local.where("block > 0").join(carries, ["conv", "block"])
    return local.where("block = 0").unionByName(later.mapInArrow(thrifty(_add_carry), _PATH))


# -- the compacted trie -------------------------------------------------------------------


def two_fattest(low: Column, high: Column) -> Column:
    """The number in ``(low, high]`` with most trailing zero bits."""
    bits = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


class Trie:
    """Sequences with their prefix hashes, and the node table that grows by batches."""

    def __init__(self, sequences: DataFrame, paths: DataFrame, block: int):
        self.sequences, self.paths, self.block = sequences, paths, block
        first = sequences.agg(F.max("length").alias("length"), F.min("conv").alias("conv")).first()
        self.longest = first["length"] or 0
        values = dict(zip([*_KEY, "above", "rep"], [0, 0, 0, -1, first["conv"]], strict=True))
        self.root = F.struct(*(F.lit(v).cast("long").alias(x) for x, v in values.items()))
        root = sequences.sparkSession.range(1).select(
            *(F.lit(v).cast("long").alias(x) for x, v in values.items()),
            *(F.lit(None).cast("long").alias(x) for x in ("fd", "fp", "fq", "hd", "hp", "hq")),
        )
        self.nodes = stored(root, "trie-nodes")

    def at(self, rows: DataFrame, conv: str, depth: Column, names: str) -> DataFrame:
        """``rows`` with hash and code points of ``conv``'s prefix of that depth, null without a depth."""
        number = F.greatest(F.floor((depth - 1) / self.block).cast("long"), F.lit(0))
        place = (F.col("__depth") - F.col("__block") * self.block + 1).cast("int")
        path = self.paths.select(
            F.col("conv").alias("__conv"), F.col("block").alias("__number"), *(F.col(x).alias(f"__{x}") for x in "pqs")
        )
        wide = rows.withColumns({"__depth": depth, "__block": number})
        wide = wide.join(path, (F.col(conv) == F.col("__conv")) & (F.col("__block") == F.col("__number")), "left")
        # A sequence without turns has no block; its only prefix is the root.
        found = [F.when(F.col("__depth") == 0, F.lit(0)).otherwise(F.try_element_at(f"__{x}", place)) for x in "pqs"]
        return wide.select(*rows.columns, *(x.cast("long").alias(names + n) for x, n in zip(found, "pqs", strict=True)))

    def _coarse(self) -> DataFrame:
        """``(conv, cp, cq)``: prefixes at whole blocks, of sequences over one block."""
        rows = F.sort_array(F.collect_list(F.struct("block", F.col("p")[0].alias("p"), F.col("q")[0].alias("q"))))
        found = self.paths.where("block > 0").groupBy("conv").agg(rows.alias("rows"))
        return found.select("conv", F.col("rows.p").alias("cp"), F.col("rows.q").alias("cq"))

    def _probe(self, rows: DataFrame, active: Column, depth: Column, p: Column, q: Column) -> DataFrame:
        """One step of the search for a whole batch."""
        handles = self.nodes.where("hd IS NOT NULL").select(
            "hd", "hp", "hq", F.struct(*_KEY, "above", "rep").alias("hit")
        )
        # Searches that have ended ask for depths nobody has, spread by conversation.
        asked = rows.withColumns({"fd": F.when(active, depth).otherwise(-1)}).withColumns(
            {"fp": F.when(active, p).otherwise(F.col("conv")), "fq": F.when(active, q).otherwise(0)}
        )
        met = (F.col("fd") == F.col("hd")) & (F.col("fp") == F.col("hp")) & (F.col("fq") == F.col("hq"))
        found = asked.join(handles, met, "left").drop("hd", "hp", "hq")
        hit = F.col("hit").isNotNull()
        found = found.withColumns(
            {
                "low": F.when(hit, F.least("hit.depth", "high")).otherwise(F.col("low")),
                "high": F.when(~hit & (F.col("fd") > 0), F.col("fd") - 1).otherwise(F.col("high")),
                "node": F.coalesce("hit", "node"),
            }
        )
        return found.select(rows.columns)

    def _paused(self, state: DataFrame, step: int) -> DataFrame:
        """Writes the search after some steps: the driver holds a plan's description once for each of its stages."""
        return stored(state, "trie-search") if step % STEPS == STEPS - 1 else state

    def from_root(self, batch: DataFrame) -> DataFrame:
        return batch.select(
            "conv", "length", "p", "q", self.root.alias("exit"), F.lit(0).cast("long").alias("common")
        )

    def locate(self, batch: DataFrame) -> DataFrame:
        """``(conv, length, p, q, exit, common)``: exit node, and depth up to which the sequence is there."""
        block = self.block
        state = batch.select(
            "conv", "length", "p", "q", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"), self.root.alias("node")
        )
        low, high = F.col("low"), F.col("high")
        fattest = two_fattest(low, high)
        if self.longest >= block:
            state = state.join(self._coarse(), "conv", "left")
            for step in range((self.longest // block).bit_length()):
                active = F.floor(low / block) < F.floor(high / block)
                place, whole = F.floor(fattest / block).cast("int"), fattest == F.col("length")
                p = F.when(whole, F.col("p")).otherwise(F.try_element_at("cp", place))
                q = F.when(whole, F.col("q")).otherwise(F.try_element_at("cq", place))
                state = self._paused(self._probe(state, active, fattest, p, q), step)
            state = state.drop("cp", "cq")
        path = self.paths.select(F.col("conv").alias("c"), F.col("block").alias("k"), F.col("p").alias("bp"), F.col("q").alias("bq"))
        number = F.floor(high / block).cast("long")
        state = state.join(path, (F.col("conv") == F.col("c")) & (number == F.col("k")), "left").drop("c", "k")
        state = state.withColumn("k", number)
        for step in range(min(self.longest, block - 1).bit_length()):
            place = (fattest - F.col("k") * block + 1).cast("int")
            found = self._probe(
                state, low < high, fattest, F.try_element_at("bp", place), F.try_element_at("bq", place)
            )
            state = self._paused(found, step)
        state = stored(state.select("conv", "length", "p", "q", "node"), "trie-search")
        # The deepest node whose handle is on the path; the exit may be its child along the next turn.
        below = F.when(F.col("node.depth") < F.col("length"), F.col("node.depth") + 1)
        state = self.at(state, "conv", below, "n").withColumns(
            {"nd": F.coalesce(below, F.lit(-1)), "np": F.coalesce("np", "conv"), "nq": F.coalesce("nq", F.lit(0))}
        )
        children = self.nodes.where("fd IS NOT NULL").select(
            "fd", "fp", "fq", F.struct(*_KEY, "above", "rep").alias("child")
        )
        met = (F.col("nd") == F.col("fd")) & (F.col("np") == F.col("fp")) & (F.col("nq") == F.col("fq"))
        state = state.join(children, met, "left").select(
            "conv", "length", "p", "q", F.coalesce("child", "node").alias("exit")
        )
        return self._common(state)

    def _common(self, state: DataFrame) -> DataFrame:
        block, equal = self.block, lambda z: (z["a"] == z["c"]) & (z["b"] == z["d"])

        def alike(a: str, b: str, c: str, d: str) -> Column:
            pairs = F.arrays_zip(*(F.coalesce(F.col(x), F.array().cast("array<long>")).alias(n) for x, n in zip((a, b, c, d), "abcd", strict=True)))
            return F.size(F.filter(pairs, lambda z: F.coalesce(equal(z), F.lit(False))))

        state = state.withColumn("k", F.lit(0).cast("long"))
        if self.longest >= block:
            mine, other = self._coarse(), self._coarse().toDF("c", "dp", "dq")
            state = state.join(mine, "conv", "left").join(other, F.col("exit.rep") == F.col("c"), "left").drop("c")
            state = state.withColumn("k", alike("cp", "cq", "dp", "dq").cast("long")).drop("cp", "cq", "dp", "dq")
        for conv, names in (("conv", ("xp", "xq")), ("exit.rep", ("yp", "yq"))):
            path = self.paths.select(
                F.col("conv").alias("c"), F.col("block").alias("b"), F.col("p").alias(names[0]), F.col("q").alias(names[1])
            )
            state = state.join(path, (F.col(conv) == F.col("c")) & (F.col("k") == F.col("b")), "left").drop("c", "b")
        same = F.col("k") * block + F.greatest(alike("xp", "xq", "yp", "yq") - 1, F.lit(0))
        common = F.least(same, F.col("exit.depth"), F.col("length")).cast("long")
        return state.select("conv", "length", "p", "q", "exit", common.alias("common"))

    def steps(self, rows: DataFrame, above: Column, last: Column, keep: list[str]) -> DataFrame:
        """One row for each depth in ``(above, last]`` of ``conv``: its hash, code points and the hash before."""
        block = self.block
        reach = (F.col("block") * block < last) & ((F.col("block") + 1) * block > above)
        wide = rows.withColumns({"__above": above, "__last": last}).join(
            self.paths.select(F.col("conv"), "block", F.col("p").alias("ps"), F.col("q").alias("qs"), F.col("s").alias("ss")),
            "conv",
        )
        wide = wide.where(reach)
        base = F.col("block") * block
        first = F.greatest(F.col("__above") - base + 1, F.lit(1)).cast("int")
        end = F.least(F.col("__last") - base, F.size("ps") - 1).cast("int")
        picked = F.transform(
            F.sequence(first, end),
            lambda k: F.struct(
                (base + k).cast("long").alias("depth"),
                F.col("ps")[k].alias("p"),
                F.col("qs")[k].alias("q"),
                F.col("ps")[k - 1].alias("up"),
                F.col("qs")[k - 1].alias("uq"),
                F.col("ss")[k - 1].alias("us"),
            ),
        )
        return wide.select(*keep, F.explode(picked).alias("__step")).select(*keep, "__step.*")

    def insert(self, located: DataFrame) -> None:
        """Add the nodes of a located batch and give split edges their new intervals."""
        key = [F.col(f"exit.{x}").alias(x) for x in _KEY]
        tails = located.where("common < length")
        new = self.steps(tails, F.col("common"), F.col("length"), ["conv", "common"])
        # Where tails of this batch part: prefixes with two different next turns.
        turns = new.where("depth - 1 > common").select((F.col("depth") - 1).alias("depth"), "up", "uq", "p", "q").distinct()
        parting = turns.groupBy("depth", F.col("up").alias("p"), F.col("uq").alias("q")).count().where("count > 1")
        ends = tails.select(F.col("length").alias("depth"), "p", "q")
        points = parting.select(_KEY).unionByName(ends).distinct()
        marks = new.select("conv", *_KEY).join(points, _KEY, "left_semi").select("conv", *_KEY)
        none = F.lit(None).cast("long")
        marks = marks.unionByName(tails.select("conv", F.col("common").alias("depth"), none.alias("p"), none.alias("q")))
        before = F.lag("depth").over(Window.partitionBy("conv").orderBy("depth"))
        added = marks.withColumn("above", before).where("p IS NOT NULL")
        added = added.groupBy(_KEY).agg(F.min("above").alias("above"), F.min("conv").alias("rep"))
        # Exits inside edges.
        inside = located.where("common < exit.depth")
        cuts = inside.groupBy(*key, F.col("exit.above").alias("start"), "common").agg(F.min("conv").alias("rep"))
        order = Window.partitionBy(_KEY).orderBy("common")
        cuts = cuts.withColumn("above", F.coalesce(F.lag("common").over(order), "start"))
        splits = self.at(cuts.select("common", "above", "rep"), "rep", F.col("common"), "x")
        splits = splits.select(F.col("common").alias("depth"), F.col("xp").alias("p"), F.col("xq").alias("q"), "above", "rep")
        moved = cuts.groupBy(_KEY).agg(F.max("common").alias("to"))
        nodes = self.nodes.join(moved, _KEY, "left")
        kept = nodes.where("to IS NULL").drop("to")
        fresh = nodes.where("to IS NOT NULL").select(*_KEY, F.col("to").alias("above"), "rep")
        fresh = fresh.unionByName(splits).unionByName(added)
        fresh = self.at(fresh, "rep", F.col("above") + 1, "f").withColumn("fd", F.col("above") + 1).drop("fs")
        handle = two_fattest(F.col("above"), F.col("depth"))
        fresh = self.at(fresh, "rep", handle, "h").withColumn("hd", handle).drop("hs")
        self.nodes = stored(kept.unionByName(fresh), "trie-nodes")


def build(sequences: DataFrame, paths: DataFrame, block: int = BLOCK, batches: tuple[int, ...] = BATCHES) -> Trie:
    """The compacted trie of distinct ``sequences`` ``(conv, length, p, q)``, filled in batches."""
    trie = Trie(sequences, paths, block)
    number = F.pmod(F.xxhash64("p", "q"), F.lit(batches[-1]))
    least = 0
    for most in batches:
        batch = sequences.where((number >= least) & (number < most))
        # Nothing is to be searched before the first batch is in: all exits are at the root.
        located = trie.locate(batch) if least else trie.from_root(batch)
        trie.insert(stored(located, "trie-exits"))
        least = most
    return trie


# -- digests of the ids that end at a node -------------------------------------------------


def ends_digest(members: DataFrame) -> DataFrame:
    """``(depth, p, q, ends_sha256)`` of the ids ``conv`` that end at each node, ascending and comma-joined.

    Ids are sorted in ranges and joined to strings there; a node's strings stream through
    one hash, in order.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in parts:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).to_numpy() for x in _KEY])
            starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
            ids = [str(x) for x in batch.column("conv").to_pylist()]
            ends = [*starts[1:].tolist(), len(ids)]
            texts = [",".join(ids[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x[starts]) for x in keys),
                    pa.array(np.full(len(starts), part, np.int64)),
                    pa.array(number + np.arange(len(starts), dtype=np.int64)),
                    pa.array(texts, pa.large_string()),
                ],
                names=[*_KEY, "part", "number", "ids"],
            )
            number += len(starts)

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in parts:
            out = []
            for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*_KEY, "ids")), strict=True):
                if key != at:
                    if state:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*_KEY, "ends_sha256"])
        if state:
            last = (*at, state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names=[*_KEY, "ends_sha256"])

    rows = members.select(*_KEY, "conv").repartitionByRange(tasks, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    texts = rows.mapInArrow(thrifty(join), "depth long, p long, q long, part long, number long, ids string")
    texts = texts.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "part", "number")
    return texts.mapInArrow(thrifty(digest), "depth long, p long, q long, ends_sha256 string")


# -- all nodes -----------------------------------------------------------------------------


def prefix_trie(
    turns: DataFrame, ids: DataFrame, block: int = BLOCK, batches: tuple[int, ...] = BATCHES
) -> DataFrame:
    """One row for each prefix of the conversations' turns.

    ``turns`` has ``(conv, depth, t1, t2, chars)`` (see :func:`turn_hashes`) with depths 1,
    2, ... of each conversation, ``ids`` has all conversations, ``conv``, also those without a turn.
    """
    paths = stored(prefix_blocks(turns, block), "trie-paths")
    last = F.max(
        F.struct("block", F.size("p").alias("n"), F.element_at("p", -1).alias("p"), F.element_at("q", -1).alias("q"))
    )
    ends = paths.groupBy("conv").agg(last.alias("last")).select(
        "conv", (F.col("last.block") * block + F.col("last.n") - 1).alias("depth"), "last.p", "last.q"
    )
    members = ids.select(F.col("conv").cast("long").alias("conv")).where("conv IS NOT NULL").distinct()
    members = members.join(ends, "conv", "left").na.fill(0, _KEY)
    members = stored(members.select("conv", *(F.col(x).cast("long").alias(x) for x in _KEY)), "trie-members")
    sequences = members.groupBy(_KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    sequences = stored(sequences.withColumnRenamed("depth", "length"), "trie-sequences")
    paths = stored(paths.join(sequences.select("conv"), "conv", "left_semi"), "trie-distinct")
    trie = build(sequences, paths, block, batches)

    # Parents and children of the compacted nodes.
    nodes = trie.at(trie.nodes.select(*_KEY, "above", "rep"), "rep", F.col("depth"), "b")
    nodes = trie.at(nodes.drop("bp", "bq"), "rep", F.when(F.col("above") >= 0, F.col("above")), "a")
    nodes = stored(nodes, "trie-compact")
    up = [F.col("above").alias("depth"), F.col("ap").alias("p"), F.col("aq").alias("q")]
    children = nodes.where("above >= 0").groupBy(*up).agg(F.count("*").alias("children"))
    nodes = nodes.join(children, _KEY, "left").na.fill(0, ["children"])

    # Members and leaves below: sums over the prefixes of all sequences.
    leaf = nodes.where("children = 0").select(F.col("depth").alias("length"), "p", "q", F.lit(1).alias("leaf"))
    whole = sequences.join(leaf, ["length", "p", "q"], "left").na.fill(0, ["leaf"])
    keep = ["conv", "n", "leaf"]
    zero = [F.lit(0).cast("long").alias(x) for x in _KEY]
    below = trie.steps(whole.drop("p", "q"), F.lit(0), F.col("length"), keep).select(*keep, *_KEY)
    below = below.unionByName(whole.select(*keep, *zero))
    sums = below.groupBy(_KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("leaf").cast("long").alias("n_leaves")
    )
    nodes = stored(nodes.join(sums, _KEY), "trie-counted")

    # Saved tokens: a shared edge counts at all nodes above it.
    saved = (F.col("n_convs") - 1) * (F.col("bs") - F.col("as"))
    shared = nodes.where("above >= 0 AND n_convs > 1").select(
        F.col("rep").alias("conv"), "above", saved.alias("saved")
    )
    upward = trie.steps(shared, F.lit(0), F.col("above"), ["saved"]).select("saved", *_KEY)
    upward = upward.unionByName(shared.select("saved", *zero)).groupBy(_KEY).agg(F.sum("saved").alias("saved_below"))
    nodes = nodes.join(upward, _KEY, "left").na.fill(0, ["saved_below"])
    nodes = stored(nodes.join(ends_digest(members), _KEY, "left"), "trie-summed")

    # Parents' smallest members, then every edge as the nodes on it.
    parents = nodes.select(*_KEY, F.col("conv_id").alias("parent")).toDF("above", "ap", "aq", "parent")
    nodes = stored(nodes.join(parents, ["above", "ap", "aq"], "left"), "trie-whole")
    keep = ["above", "rep", "bs", "children", "n_convs", "conv_id", "n_leaves", "saved_below", "ends_sha256", "parent", "last"]
    edges = nodes.where("above >= 0").withColumns({"last": F.col("depth"), "conv": F.col("rep")}).drop(*_KEY)
    edges = trie.steps(edges, F.col("above"), F.col("last"), keep)
    root = nodes.where("above < 0").withColumns({"last": F.col("depth"), "us": F.col("bs")})
    every = edges.select(*keep, "depth", "us").unionByName(root.select(*keep, "depth", "us"))
    own, nobody = F.col("depth") == F.col("last"), hashlib.sha256(b"").hexdigest()
    return every.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("above") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(own, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved_below") + (F.col("n_convs") - 1) * (F.col("bs") - F.col("us"))).alias("saved_tokens"),
        F.coalesce(F.when(own, F.col("ends_sha256")), F.lit(nobody)).alias("ends_sha256"),
    )
