"""Exact duplicates, similar sets and repeated lines against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyledger.llm import edits, exact_dedup, jaccard_join, line_dedup
from tidyledger.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, class string, n long, root long, key string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", 1, 2, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    found = words(text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)}


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def corpus():
    """Copies, near copies in a chain, shared passages, short, long and empty texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [vocabulary[k] for k in rng.integers(0, 400, n)]
    passage = draw(30)
    texts = [None, "", " \n\t", "One two", "one  TWO", "Ünï ÄÖ ö", "ÜnÏ ÄÖ ö", "a b c d", "a b c d e", "A b c d e"]
    for _ in range(12):
        base = draw(int(rng.integers(20, 160)))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            base = list(base)
            for _ in range(int(rng.integers(1, 4))):
                base[int(rng.integers(0, len(base)))] = vocabulary[int(rng.integers(0, 400))]
            texts.append(" ".join(base))
    texts += [" ".join(draw(15) + passage + draw(15)) for _ in range(10)]
    texts += [texts[12], texts[12].upper(), "z " * 5000 + "end", " ".join(draw(3000))]
    return texts


@pytest.mark.parametrize("group", [512, 3])
def test_similar_sets(spark, group):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [
        (a, b)
        for a, b in combinations(range(len(sets)), 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = roots(range(len(sets)), links)
    assert len(set(want.values())) < len(texts) - 10
    found = jaccard_join.jaccard_components(frame(spark, texts), group=group, fragment_bytes=5000).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == {
        k: (len(sets[k]), want[k]) for k in range(len(sets))
    }


def test_large_groups_are_dealt_out(spark):
    """A chain of near copies: most are not similar to the first, and all are connected."""
    base = [f"v{k}" for k in range(60)]
    texts = []
    for k in range(40):
        base = list(base)
        base[k] = f"new{k}"
        texts.append(" ".join(base))
    found = jaccard_join.jaccard_components(frame(spark, texts), group=4, fragment_bytes=2000).collect()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(40), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {x["doc_id"]: x["component_id"] for x in found} == roots(range(40), links)


def test_similar_sets_of_odd_tables(spark):
    empty = frame(spark, []).drop("key")
    assert jaccard_join.jaccard_components(empty).count() == 0
    rows = frame(spark, [None, None, "a b c d e f", "a b c d e f", "a b c d e f"], [7, None, 3, 3, None])
    found = sorted(map(str, jaccard_join.jaccard_components(rows).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == sorted(
        f"Row(doc_id={a}, n_shingles={b}, component_id={c})"
        for a, b, c in [(7, 0, 7), (None, 0, None), (3, 2, 3), (3, 2, 3), (None, 2, 3)]
    )


@pytest.mark.parametrize("history", ["id % 2 = 0", "true", "false", "null"])
def test_exact_duplicates(spark, history):
    texts = corpus() + [None, "ONE TWO", "one two\n"]
    ids = [*range(len(texts) - 1), None]
    rows = frame(spark, texts, ids)
    norm = [(t or "").translate(LOWER) for t in texts]
    size = Counter(norm)
    keep = {}
    for i, t in zip(ids, norm, strict=True):
        keep[t] = max(keep.get(t, -1), -1 if i is None else i)
    found = exact_dedup.exact_duplicates(rows, F.expr(history).cast("boolean"), bucket_keys=7).collect()
    want = {
        i: (hashlib.sha256(t.encode()).hexdigest(), keep[t] if keep[t] >= 0 else None, size[t], i is None or keep[t] == i)
        for i, t in zip(ids, norm, strict=True)
    }
    assert len(found) == len(texts)
    assert {x["id"]: (x["digest"].hex(), x["keep_id"], x["group_size"], x["kept"]) for x in found} == want


def test_exact_duplicates_keep_one_of_repeated_rows(spark):
    rows = frame(spark, ["a", "A", "a", None], [1, 1, 1, 1])
    found = exact_dedup.exact_duplicates(rows, F.lit(True)).collect()
    assert sorted((x["group_size"], x["kept"]) for x in found) == [(1, True), (3, False), (3, False), (3, True)]
    assert exact_dedup.exact_duplicates(frame(spark, []), F.lit(True)).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels, slots = exact_dedup.build(keys)
    assert sorted(slots) == list(range(5000))
    assert (exact_dedup.find(levels, keys) == slots).all()
    strangers = rng.integers(0, 256, (1000, 32), dtype=np.uint8)
    at = exact_dedup.find(levels, strangers)
    assert at.min() >= -1 and at.max() < 5000


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 500)]
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5), "test").collect()
    nodes = {x for link in links for x in link if link[0] != link[1]}
    assert {x["node"]: x["root"] for x in found} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = "".join(rng.choice(list("abc é"), rng.integers(0, 40)))
        b = "".join(rng.choice(list("abc é"), rng.integers(0, 40)))
        assert line_dedup.edit_distance(a, b) == distance(a, b)
        assert line_dedup.edit_distance(a, a[:10] + b[:3] + a[10:]) == distance(a, a[:10] + b[:3] + a[10:])


def test_alike_is_the_edit_distance_within_a_limit():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = [f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 40))]
        b = list(a) if rng.random() < 0.8 else [f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 40))]
        for _ in range(int(rng.integers(0, 8))):
            k, way = int(rng.integers(0, len(b) + 1)), int(rng.integers(0, 3))
            b[k : k + (way > 0)] = [f"x{way}é"] * (way < 2)
        a, b = " ".join(a), " ".join(b)
        right, limit = distance(a, b), 0.15 * max(len(a), len(b)) + 1e-9
        near = line_dedup._by_words(a, b, limit)
        assert near is None or right <= near <= limit
        given_up = line_dedup.edit_distance(a, b, limit)
        assert given_up == right if right <= limit else given_up > limit
        assert line_dedup.alike(a, b, limit) == (right <= limit)


def test_strangers_are_given_up_before_their_end():
    rng = np.random.default_rng(8)
    a, b = ("".join(rng.choice(list("abcdefgh "), 2000)) for _ in range(2))
    assert 300 < line_dedup.edit_distance(a, b, 300) < line_dedup.edit_distance(a, b)


def line_texts():
    rng = np.random.default_rng(6)
    draw = lambda n: [f"word{k}" for k in rng.integers(0, 3000, n)]
    texts = [None, "", "\n\n", "Short line", "short line\nShort line", "a b c d e\n", "\nA  b c\td e\r\nx"]
    bases = [draw(int(rng.integers(5, 90))) for _ in range(25)]
    for _ in range(40):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            line = list(bases[int(rng.integers(0, len(bases)))]) if rng.random() < 0.5 else draw(int(rng.integers(1, 60)))
            if rng.random() < 0.5 and len(line) > 8:
                line[int(rng.integers(0, len(line)))] += "x"
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("group", [512, 2])
def test_repeated_lines(spark, group):
    texts = line_texts()
    rows = frame(spark, texts)
    lines = [(d, k, words(x), x) for d, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n"))]
    long = [x for x in lines if len(x[2]) >= 5]
    norm = [" ".join(x[3].encode().lower().decode().split()) for x in long]
    data = "".join(norm).encode()
    ends = np.cumsum([len(x.encode()) for x in norm])
    places, sizes = line_dedup.minima(np.frombuffer(data, np.uint8), ends - np.diff(ends, prepend=0), ends)
    agree = lambda a, b: int((places[a] == places[b]).sum())
    meet = lambda a, b: any((places[a][list(x)] == places[b][list(x)]).all() for x in line_dedup.PLANE)
    fit = lambda a, b: min(sizes[a], sizes[b]) >= line_dedup.SIMILARITY * max(sizes[a], sizes[b])
    links = [
        (a, b)
        for a, b in combinations(range(len(long)), 2)
        if agree(a, b) >= line_dedup.AGREE
        and fit(a, b)
        and distance(norm[a], norm[b]) <= (1 - line_dedup.SIMILARITY) * max(len(norm[a]), len(norm[b])) + 1e-9
    ]
    sure = [x for x in links if meet(*x)]  # others are linked only where a third line brings them together
    assert roots(range(len(long)), links) == roots(range(len(long)), sure)
    fuzzy = sum(norm[a] != norm[b] for a, b in links)
    assert fuzzy > 10
    group_of = roots(range(len(long)), links)
    gone = {long[k][:2] for k, first in group_of.items() if k != first}
    found = {x["doc_id"]: x for x in line_dedup.drop_repeated_lines(rows, group=group).collect()}
    for d, text in enumerate(texts):
        parts = [] if text is None else text.split("\n")
        kept = [x for k, x in enumerate(parts) if (d, k) not in gone]
        assert found[d]["text"] == (None if text is None else "\n".join(kept)), d
        assert (found[d]["lines_read"], found[d]["lines_dropped"]) == (len(parts), len(parts) - len(kept))
    assert set(found[0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], "lines_read", "lines_dropped"}


def test_repeated_lines_of_odd_tables(spark):
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0
    rows = frame(spark, ["a b c d e", "a b c d e", "A b c d  e", "x\na b c d e"], [5, 5, None, 9])
    found = sorted((str(x["doc_id"]), x["text"]) for x in line_dedup.drop_repeated_lines(rows).collect())
    # The rows that repeat id and text count as one; the null id comes last.
    assert found == [("5", "a b c d e"), ("5", "a b c d e"), ("9", "x"), ("None", "")]


def test_fuzzy_repeats_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäß"))
    draw = lambda: "".join(rng.choice(letters, int(rng.integers(4, 9))))
    pairs = []
    for size in [8, 12, 20, 30, 50] * 24:
        one = [draw() for _ in range(size)]
        two = list(one)
        for k in rng.choice(size, max(1, size // 20), replace=False):
            two[k] = draw()
        one, two = " ".join(one), " ".join(two)
        if distance(one, two) <= (1 - line_dedup.SIMILARITY) * max(len(one), len(two)):
            pairs.append((one, two))
    assert len(pairs) > 80
    rows = frame(spark, [f"{one}\n{two}" for one, two in pairs])
    found = {x["doc_id"]: x for x in line_dedup.drop_repeated_lines(rows).collect()}
    lost = [k for k, (one, _) in enumerate(pairs) if found[k]["text"] != one]
    assert len(lost) <= 0.02 * len(pairs), len(lost)


def test_ten_equal_places_always_meet():
    for points in combinations(range(line_dedup.PLACES), 6):
        assert any(set(points).isdisjoint(x) for x in line_dedup.PLANE)


def near_texts(rng, count, size, letters):
    """Texts of about one length, half of them with a few edits of another one."""
    texts = []
    for _ in range(count):
        text = list(rng.choice(list(letters), int(size * rng.uniform(0.9, 1.1)) + 1))
        texts.append("".join(text))
        for _ in range(int(rng.integers(0, max(2, size // 5)))):
            k, way = int(rng.integers(0, len(text) + 1)), int(rng.integers(0, 3))
            text[k : k + (way > 0)] = [str(rng.choice(list(letters)))] * (way < 2)
        texts.append("".join(text) or "a")
    return texts


@pytest.mark.parametrize("size", [1, 20, 64, 150, 700])
def test_many_pairs_are_compared_at_once(size):
    rng = np.random.default_rng(size)
    texts = near_texts(rng, 40, size, "abc é漢\U0001f600x")
    a = rng.integers(0, len(texts), 200)
    b = np.where(rng.random(200) < 0.6, a ^ 1, rng.integers(0, len(texts), 200))
    sizes = np.array([len(x) for x in texts])
    limits = 0.15 * np.maximum(sizes[a], sizes[b]) + 1e-9
    right = [line_dedup.edit_distance(texts[i], texts[j]) <= x for i, j, x in zip(a, b, limits, strict=True)]
    assert edits.within(texts, a, b, limits).tolist() == right
    assert 0 < sum(right) < 200


@pytest.mark.parametrize("left", [None, 3])
def test_links_of_groups_that_are_compared_together(left, monkeypatch):
    rng = np.random.default_rng(9)
    same = np.zeros(line_dedup.PLACES, np.uint16).tobytes()
    groups = [near_texts(rng, int(n), 60, "abcdefgh ") for n in (1, 2, 9, 30, 60)]
    alone = []
    monkeypatch.setattr(line_dedup, "alike", lambda *x: alone.append(x) or line_dedup.edit_distance(*x) <= x[2])
    found = line_dedup.line_links(0.85)([([(x, same) for x in texts], left and min(left, len(texts))) for texts in groups])
    pairs = 0
    for texts, links in zip(groups, found, strict=True):
        roots, right = list(range(len(texts))), list(range(len(texts)))
        for a in range(len(texts) if left is None else min(left, len(texts))):
            for b in range(len(texts)):
                limit = 0.15 * max(len(texts[a]), len(texts[b])) + 1e-9
                pairs += a < b
                if line_dedup.edit_distance(texts[a], texts[b]) <= limit:
                    right = [right[a] if x == right[b] else x for x in right]
        for a, b in links:
            assert left is None or a < left
            assert line_dedup.edit_distance(texts[a], texts[b]) <= 0.15 * max(len(texts[a]), len(texts[b])) + 1e-9
            roots = [roots[a] if x == roots[b] else x for x in roots]
        assert {tuple(np.flatnonzero(np.array(roots) == x)) for x in roots} == {
            tuple(np.flatnonzero(np.array(right) == x)) for x in right
        }
    assert len(alone) < 0.1 * pairs  # most pairs are not compared one by one
