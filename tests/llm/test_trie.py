"""The prefix trie against a plain one, and its parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidyledger.llm import prefix_trie as pt
from tidyledger.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, p long, q long"


def slow(sequences):
    """Nodes of {conv: [(role, text), ...]} as the query returns them."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(sequences):
        path = tuple(sequences[conv])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (
            convs[0],
            len(path),
            members[path[:-1]][0] if path else -1,
            len(convs),
            children[path],
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def read(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if x is None else x for x in row) for row in df.collect())


def trie_of(spark, sequences, **sizes):
    rows = [(c, d, r, t) for c, turns in sequences.items() for d, (r, t) in enumerate(turns, 1)]
    turns = spark.createDataFrame(rows, "conv long, depth long, role string, text string").repartition(5)
    turns = turns.select("conv", "depth", *(x.alias(n) for n, x in pt.turn_hashes().items()))
    ids = spark.createDataFrame([(c,) for c in sequences], "conv long")
    return read(pt.prefix_trie(turns, ids, **sizes))


def random_sequences(count=220, seed=2):
    pick = random.Random(seed)
    turn = lambda: (pick.choice(["user", "assistant"]), pick.choice(["", "a", "bb", "ccc\U0001f600"]))
    out = {}
    for k in range(count):
        if out and pick.random() < 0.7:  # most go on from a prefix of another one
            old = out[pick.choice(sorted(out))]
            start = old[: pick.randint(0, len(old))]
        else:
            start = []
        out[pick.choice([-1, 1]) * (k * 7 + 1)] = start + [turn() for _ in range(pick.choice([0, 0, 1, 2, 3, 9, 30]))]
    return out


@pytest.mark.parametrize("sizes", [{"block": 4}, {"block": 1024, "batches": (3, 16)}])
def test_against_plain_trie(spark, sizes):
    sequences = random_sequences()
    assert trie_of(spark, sequences, **sizes) == slow(sequences)


def test_copies_chains_and_empty(spark):
    chain = [("user", "x")] * 40  # the same turn again and again
    sequences = {k: chain for k in range(0, 60)} | {100 + k: chain[:k] for k in range(0, 40, 3)} | {500: []}
    assert trie_of(spark, sequences, block=8, batches=(4, 16)) == slow(sequences)
    assert trie_of(spark, {7: []}, batches=(16,)) == slow({7: []})


def test_no_conversation(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).collect() == []


def test_query(spark, tmp_path):
    """Nulls, ties, repeated rows, missing first conversations, negative ids, further columns."""
    pick = random.Random(9)
    rows = []
    for conv in [None, *range(-230, -190), -100, 0, *range(2, 60), 300, *range(500, 530), 799]:
        for _ in range(pick.choice([1, 2, 3, 8, 20])):
            turn = pick.choice([None, *range(12)])
            rows.append((conv, turn, pick.choice(["user", "assistant", None]), pick.choice(["", None, "a", "b", "c"]), "k", 1, 2, 3))
    rows += [(300, 5, "user", "again", "k", 1, 2, 3)] * 4
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    hashes = {}
    kinds = spark.createDataFrame(list({(r, t) for _, _, r, t, *_ in rows}), "role string, text string")
    for x in kinds.select("role", "text", *(c.alias(n) for n, c in pt.turn_hashes().items())).collect():
        hashes[x["role"], x["text"]] = (x["t1"], x["t2"])
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn), role or "", hashes[role, text], (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    sequences = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        sequences[conv] = own.get(base, [])[:h] + turns[h:]
    assert read(queries.op12_prefix_trie(spark, str(tmp_path))) == slow(sequences)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 70) for b in range(a + 1, 70)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for x in df.select("a", "b", pt.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert x["f"] == max(range(x["a"] + 1, x["b"] + 1), key=lambda n: n & -n)


def test_blocks_of_a_long_conversation(spark):
    turns = [("user", str(k % 11)) for k in range(700)]
    rows = [(c, d, r, t) for c in (1, 2) for d, (r, t) in enumerate(turns[: 700 - c], 1)]
    df = spark.createDataFrame(rows, "conv long, depth long, role string, text string")
    df = df.select("conv", "depth", *(x.alias(n) for n, x in pt.turn_hashes().items()))
    found = [
        {(x["conv"], x["block"] * size + k): y for x in pt.prefix_blocks(df, size).collect() for k, y in enumerate(zip(x["p"], x["q"], x["s"]))}
        for size in (16, 1024)
    ]
    assert found[0] == found[1]  # shared depths of neighbouring blocks agree as well
    assert found[0][1, 600] == found[0][2, 600]
    assert found[0][1, 600][2] == sum(len(t) for _, t in turns[:600])


def test_no_plan_holds_the_whole_search(spark, monkeypatch):
    written, stored = [], pt.stored
    monkeypatch.setattr(pt, "stored", lambda df, *x: written.append(df) or stored(df, *x))
    sequences = {k: [("user", str(k % 7 + d // 9)) for d in range(150 + k)] for k in range(40)}
    assert trie_of(spark, sequences, batches=(8, 16)) == slow(sequences)
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in written]
    assert len(joins) > 10 and max(joins) <= 9  # a search of eight steps was one plan
