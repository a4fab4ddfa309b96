"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyledger.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, number long, rank int, key string"


def slow(rows, size=5):
    """[(anchor, positive, rank, negative, positive score, negative score)] over plain lists."""
    good = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))  # noqa: E731, B905
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, (anchor, label, q) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        others = [(dot(q, v), i, b) for j, (i, b, v) in enumerate(good) if j != k]
        positives = sorted((x for x in others if x[2] == label), key=order)[:size]
        for score, positive, _ in positives:
            fit = [x for x in others if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score]
            for rank, x in enumerate(sorted(fit, key=order)[:size], 1):
                out.append((anchor, positive, rank, x[1], score, x[0]))
    return sorted(out, key=str)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*x, 1, 2, "y") for x in rows], SCHEMA).repartition(3)
    found = hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(x) for x in found.collect()), key=str)


def clustered(count=700, dims=6, seed=3):
    """Vectors round a few centres, so many negatives fall in the windows; coarse, so there are ties."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, dims))
    vectors = np.round(centres[random.integers(0, 8, count)] + 0.05 * random.normal(size=(count, dims)), 2)
    ids = random.permutation(np.arange(count) * 10)
    return [(int(i), int(x), v.tolist()) for i, x, v in zip(ids, random.integers(0, 4, count), vectors, strict=True)]


@pytest.mark.parametrize("sizes", [{}, {"candidates": 16, "anchors": 3}])
def test_against_brute_force(spark, sizes):
    rows = clustered()
    rows += [
        (None, 1, [1.0] * 6),  # no id: a candidate, never an anchor, last in ties
        (7001, None, [1.0] * 6),
        (7002, 1, None),
        (7003, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
        (7004, 2, [float("nan")] * 6),
        (7005, 2, [float("inf")] * 6),
        (7006, 2, []),
        (7007, 2, [2.0, 1.0]),
        (7100, 3, [0.5] * 9),
        *[(7200, 0, [0.5, -0.5, 0.25, 0.0, 1.0, 1.0])] * 9,  # repeated rows: one is the anchor itself
        *[(7300 + k, 1, [0.5, -0.5, 0.25, 0.0, 1.0, 1.0]) for k in range(20)],
    ]
    found = mined(spark, rows, **sizes)
    assert len(found) > 300
    assert found == slow(rows)


def test_large_numbers(spark):
    rows = [(100 * k, k % 2, [10.0 ** (3 * k), 1.0]) for k in range(6)]
    assert mined(spark, rows) == slow(rows)


def test_empty_and_lone_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(101, 1, [1.0]), (102, 2, [1.0])]) == []


def test_bounds_hold_and_prune():
    rows = clustered(900, dims=8, seed=5)
    vectors = np.floor(256 * np.array([x[2] for x in rows]))
    ids, labels = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    none = np.zeros(len(ids), bool)
    anchors = hn.Block(hn._packed(ids[:64], none[:64], labels[:64], vectors[:64], 0, 1))
    block = hn.Block(hn._packed(ids, none, labels, vectors, 0, 0))
    true, scored = vectors[:64] @ vectors.T, 0

    def wanted(k, low, high):
        assert (low <= true[k]).all() and (true[k] <= high).all()
        return np.flatnonzero(high >= 0.8 * true[k].max())

    for k, again, scores in hn.tree_scores(anchors, block, wanted):
        assert (scores == true[k][again]).all()
        scored += len(again)
    assert scored < 0.5 * 64 * len(ids)  # within a cluster edges are short: most candidates keep their bounds


def test_spanning_tree():
    vectors = np.random.default_rng(1).normal(size=(30, 4))
    parents, edges = hn.spanning_tree(vectors)
    nodes = np.vstack((vectors, np.zeros(4)))
    apart = np.sqrt(((nodes[:, None] - nodes[None]) ** 2).sum(2))
    assert np.allclose(edges, [apart[k, p] for k, p in enumerate(parents)])
    joined, total = {30}, 0.0  # the plain method: always the shortest edge to what is joined
    while len(joined) < 31:
        d, x = min((apart[a, b], b) for a in joined for b in range(31) if b not in joined)
        joined.add(x)
        total += d
    assert math.isclose(total, edges.sum())
    for k in range(30):  # every path ends at the zero vector
        steps = 0
        while k >= 0:
            k, steps = parents[k], steps + 1
            assert steps <= 31
